"""Write pages as WARC records and read archives back past damage.

Records are gzip members of their own. The reader checks each member, header and
block digest. Of a damaged member it keeps what came out before the damage. When a
check fails it looks for the next gzip magic or version line, in the file or in what a
member held, at which a record reads whole, goes on there, and logs the bytes between.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SLICE, new_path, written

VERSION = b"WARC/1.1\r\n"
#: Fixed value: an empty gzip member. Each record is followed by one; its last byte is
#: what Spark's text writer puts between rows.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
#: Equal payloads of at least so many bytes are written once.
LEAST_REVISIT = 0
GZIP = b"\x1f\x8b\x08"
MAGIC = re.compile(rb"\x1f\x8b\x08|WARC/1\.[0-9]\r\n")
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
SALVAGED = f"path string, kind string, start long, stop long, inner_start long, inner_stop long, {RECORD}, payload binary"
VERSION_LINE = re.compile(rb"WARC/1\.[0-9]\r\n")
#: Bytes of an archive, about: the member that would pass them begins the next one, so that only a member that is larger alone makes a larger archive.
ARCHIVE = 64 << 20
#: Bytes of an archive that are unpacked at once.
STEP = 16 << 10


def base32_sha1(col: Column) -> Column:
    """Upper-case base32 of the SHA-1, in built-in functions: five hex digits are four base-32 ones."""
    hexed = F.sha1(col)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_plan(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages with digest, record type and the page a revisit refers to.

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id (null
    last) is the response; rows that repeat that page_id are responses too.
    """
    html = F.coalesce("html", F.lit(""))
    full = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html).alias("payload_digest"),
    )
    firsts = written(
        full.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
            F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
        ).where("n > 1").drop("n"),
        "warc-firsts",
    )
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return full.join(firsts, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record(page_id, url, html: str, size: int, digest: str, kind: str, refers_to) -> bytes:
    body = html.encode("utf-8", "surrogatepass") if kind == "response" else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    name = "null" if page_id is None else str(page_id)
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"\s", "%20", url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + _base32(block).decode()),
        ("X-Payload-Length", str(size)), ("Content-Type", "application/http;msgtype=response"),
    ]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    head = VERSION + lines.encode()
    return head + b"X-Header-Digest: " + _base32(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _base32(data: bytes) -> bytes:
    return base64.b32encode(hashlib.sha1(data).digest())


def members(plan: DataFrame, most: int = ARCHIVE) -> DataFrame:
    """Each row of the plan as a gzip member, and which of its task's archives, of ``most`` bytes, holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, held = 0, 0
        for b in batches:
            rows = zip(*(b[c].astype(object).where(b[c].notna(), None) for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")))
            made, where, size = [], [], 0
            for r in rows:
                made.append(gzip.compress(_record(*_ints(r)), 6, mtime=0))
                if held and held + len(made[-1]) + len(EMPTY_MEMBER) > most:
                    archive, held = archive + 1, 0
                held += len(made[-1]) + len(EMPTY_MEMBER)
                size += len(made[-1])
                where.append(archive)
                if size >= SLICE:
                    yield pd.DataFrame({"member": made, "archive": where})
                    made, where, size = [], [], 0
            yield pd.DataFrame({"member": made, "archive": where})

    return plan.mapInPandas(run, "member binary, archive int")


def _ints(row: tuple) -> tuple:
    page_id, url, html, size, digest, kind, refers_to = row
    return (None if page_id is None else int(page_id), url, html, size, digest, kind, None if refers_to is None else int(refers_to))


def write_archives(plan: DataFrame, path: str, most: int = ARCHIVE) -> None:
    """Archives of gzip members under ``path``, of ``most`` bytes, through Spark's own writer."""
    rows = members(plan, most).select(F.concat("member", F.lit(EMPTY_MEMBER[:-1])).cast("string").alias("value"), "archive")
    rows.write.partitionBy("archive").option("lineSep", EMPTY_MEMBER[-1:].decode("ascii")).text(path)


def _member(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at ``at`` holds, as far as it can be read, how far that is, and whether it is whole."""
    d, parts, view, pos = zlib.decompressobj(31), [], memoryview(data), at
    try:
        # in steps, as what a step holds beyond the member's end is copied
        while not d.eof and pos < len(data):
            parts.append(d.decompress(view[pos : pos + STEP]))
            pos += STEP
        return b"".join(parts), min(pos, len(data)) - len(d.unused_data), d.eof
    except zlib.error:
        pass
    # again in small steps, the last of them byte by byte, to keep all that comes out before the damage
    d, parts, step = zlib.decompressobj(31), [], 4096
    while step and at < len(data):
        before = d.copy()
        try:
            parts.append(d.decompress(data[at : at + step]))
            at += step
        except zlib.error:
            d, step = before, step // 64
    return b"".join(parts), min(at, len(data)), False


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int] | None:
    """The record at ``at``: headers, block, end; None unless all its checks hold: of the block, and of the header where it has one."""
    if not VERSION_LINE.match(data, at):
        return None
    head, pos = {}, at + 10
    # a header is as long as its lines are; damage shows in the first that isn't one
    while (end := data.find(b"\r\n", pos)) != pos:
        k, sep, v = data[pos : max(end, pos)].partition(b":")
        if not sep:
            return None
        if k.lower() == b"x-header-digest" and v.strip() != _base32(data[at:pos]):
            return None
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        pos = end + 2
    if not head.get("content-length", "").isdecimal():
        return None
    stop = end + 2 + int(head["content-length"])
    block = data[end + 2 : stop]
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    said = head.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != _base32(block).decode():
        return None
    return head, block, stop + 4


def _records(inner: bytes) -> Iterator[tuple[int, int, dict | None, bytes]]:
    """(start, stop, headers, block) of every whole record of what a member held; headers None for the bytes between."""
    at, lost = 0, None
    while at < len(inner):
        if r := _parse(inner, at):
            if lost is not None:
                yield lost, at, None, b""
                lost = None
            yield at, r[2], r[0], r[1]
            at = r[2]
        else:
            lost = at if lost is None else lost
            again = VERSION_LINE.search(inner, at + 1)
            at = again.start() if again else len(inner)
    if lost is not None:
        yield lost, len(inner), None, b""


def salvage(data: bytes) -> Iterator[tuple[int, int, int | None, int | None, dict | None, bytes]]:
    """(start, stop, inner start, inner stop, headers, block) of every whole record of an archive; headers None for lost bytes.

    Start and stop are places in the file: of the record, or of the member that held it,
    where the inner ones tell where. Members may hold several records. Plain archives are
    read alike. A record is lost only if its own bytes are damaged, or come after damage
    within the same member.
    """
    at, lost, n = 0, None, len(data)
    while at < n:
        found, stop, reached = [], at, at
        if data.startswith(b"\x1f\x8b", at):
            inner, stop, whole = _member(data, at)
            found = list(_records(inner))
            if not whole:
                # what is left over at the end of a broken member is part of the gap after it
                found = found[:-1] if found and found[-1][2] is None else found
                reached, stop = (stop if found else at), None
        elif r := _parse(data, at):
            found, stop = [(None, None, *r[:2])], r[2]
        else:
            stop = None
        if found:
            if lost is not None:
                yield lost, at, None, None, None, b""
                lost = None
            for inner_start, inner_stop, head, block in found:
                yield at, reached if stop is None else stop, inner_start, inner_stop, head, block
        if stop is None:
            # a cut member may have been read on into the next one, which then begins before the place reached
            again = data.find(GZIP, at + 1, reached + len(GZIP) - 1) if found else -1
            if again < 0:
                hit = MAGIC.search(data, max(at + 1, reached))
                again = hit.start() if hit else n
            if lost is None:
                lost = reached if reached < again else at
            at = again
        else:
            if lost is not None and not found:
                yield lost, at, None, None, None, b""
                lost = None
            at = stop
    if lost is not None:
        yield lost, n, None, None, None, b""


def _number(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``: kind is record or gap, start and stop are bytes of the file, the inner ones bytes of what the member there holds.

    A file is read whole by one task: archives written here are of ``ARCHIVE`` bytes. Spark
    refuses files over 2 GB, so an archive of others that is larger stops the job. Records
    whose payload doesn't match its digest are gaps. No files, no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"]):
                rows = []
                for start, stop, inner_start, inner_stop, head, block in salvage(content):
                    body = block.partition(b"\r\n\r\n")[2]
                    digest = "" if head is None else head.get("warc-payload-digest", "").removeprefix("sha1:")
                    kind = head and head.get("warc-type")
                    if kind == "response" and digest != _base32(body).decode():
                        head = None
                    if head is None:
                        rows.append((path_, "gap", start, stop, inner_start, inner_stop, None, None, None, None, None, None, None))
                        continue
                    size = head.get("x-payload-length", "")
                    size = int(size) if kind == "revisit" and size.isdecimal() else len(body)
                    rows.append((
                        path_, "record", start, stop, inner_start, inner_stop, _number(head.get("warc-record-id", "")), size, digest, kind,
                        _number(head.get("warc-refers-to", "")), head.get("warc-target-uri"), body if payloads else None,
                    ))
                    if len(rows) >= 2000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, SALVAGED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["path", "kind", "start", "stop", "inner_start", "inner_stop", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({c: "Int64" for c in ("start", "stop", "inner_start", "inner_stop", "page_id", "payload_bytes", "refers_to")})


def archive_round_trip(pages: DataFrame, least: int = LEAST_REVISIT, most: int = ARCHIVE) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return the records that were read, payloads left out.

    The bytes that could not be read, none unless storage is damaged, are logged as JSON
    in a folder beside the archives, named like theirs with ``-gaps``. A null html is an
    empty payload, a null url an empty target. A null page_id stays null. Repeated rows
    are written each. A page is one member whatever its length; one that is over 2 GB
    compressed stops the job. No pages, no rows. Other columns are not looked at.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(record_plan(pages, least), path, most)
    read = written(read_archives(pages.sparkSession, path, payloads=False), "warc-read")
    read.where("kind = 'gap'").write.json(f"{path}-gaps")
    return read.where("kind = 'record'")
