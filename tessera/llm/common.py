"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The letters whose case is folded.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: a word is a run of anything but these white-space characters.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker unfolds at once.
SLICE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPE: ContextVar[str | None] = ContextVar("tessera_scope", default=None)


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="tessera-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Only a session on one machine gets one of its own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir(spark.sparkContext.applicationId)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_SCOPE.get() or shared_dir(spark) + '/tessera'}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made within are deleted at the end: write out what depends on them before it."""
    folder = new_path(spark, "scratch")
    token = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        delete(spark, folder)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read, and rows whose values depend on where
    they were computed (row numbers, generated ids) stay what they were.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``most`` bytes of a string column at most (a longer row is a part of its own)."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(upto):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def content(df: DataFrame) -> Column:
    """A hash of all that a row holds."""
    plain = lambda t: not isinstance(t, (T.MapType, T.VariantType)) and all(map(plain, [f.dataType for f in t] if isinstance(t, T.StructType) else [t.elementType] if isinstance(t, T.ArrayType) else []))
    columns = [F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*[c if plain(f.dataType) else F.to_json(F.struct(c)) for c, f in zip(columns, df.schema)])


def numbered(df: DataFrame, name: str, *before: Column) -> DataFrame:
    """``df`` with a column that tells its rows apart, the same whenever and wherever it is read.

    The key is the file a row stands in and its place there. (A running number depends on
    how files are split into tasks, which can change as executors come and go.) What
    isn't read from files is written to the shared folder first. ``before`` are columns
    to put first in the key, so that an order by it does not hang on where files lie.
    """
    try:
        at = df.metadataColumn("_metadata")
        return df.withColumn(name, F.struct(*before, F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row")))
    except AnalysisException:
        return numbered(written(df, "rows"), name, *before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in, which does the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def word_count(text: Column) -> Column:
    """How many words a text has, 0 for null. Each word and what follows it becomes one letter; no list of words is built."""
    letters = F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(F.ltrim(letters, F.lit(WHITE))), F.lit(0)).cast("long")
