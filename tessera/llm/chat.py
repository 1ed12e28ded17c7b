"""Conversations as training text, whose turns can be read back from it.

A template marks turns with control strings. A conversation is rendered, parsed again by
a deterministic grammar and compared with what it was made of; content that stands in
the way (a control string inside a text) is escaped, until both are the same. Rows are
put in order by ranges of conversation and turn, so that a conversation of any length is
formatted by many tasks, in pieces of whole turns; pieces in order are the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece, about: a piece ends with the turn that reaches it. Pieces of a batch at most.
PIECE, BATCH = 1 << 20, 256
PIECES = "conv_id long, part int, piece long, formatted string, loss array<struct<start: long, end: long>>, first boolean, last boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

PIECE_TYPES = [
    ("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("first", pa.bool_()), ("last", pa.bool_()),
]
DIGEST_TYPES = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

Turn = tuple[str, str]


def batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])


class Malformed(ValueError):
    """The text is no sentence of the template's grammar."""


@dataclass(frozen=True)
class Template:
    """Marks around each role's texts, and around the name and text of any other role.

    The grammar: a text is (turn line-feed)*, a turn an opening mark, content without
    marks and the closing mark that belongs to the opening one; the name of another role
    stands before its content in the same way. In content a mark is escaped by a
    backslash after its first character, and one with backslashes there by one more.
    """

    roles: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    name: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    other: tuple[str, str] = ("[TEXT]", "[/TEXT]")
    #: The role whose texts are learned.
    learned: str = "assistant"
    marks: dict = field(init=False, compare=False)
    by_open: dict = field(init=False, compare=False)
    token: re.Pattern = field(init=False, compare=False)
    guarded: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        every = [m for _, *pair in self.roles for m in pair] + [*self.name, *self.other]
        if len(set(every)) < len(every) or any(len(m) < 2 or "\\" in m or "\n" in m for m in every):
            raise ValueError("marks must differ and have two characters or more, none of them a backslash or line feed")
        if any(a[-k:] == b[:k] for a in every for b in every for k in range(1, min(len(a), len(b)))) or any(a != b and a in b for a in every for b in every):
            raise ValueError("marks must not overlap")
        longest = sorted(every, key=len, reverse=True)
        object.__setattr__(self, "marks", {role: (a, b) for role, a, b in self.roles})
        object.__setattr__(self, "by_open", {a: (role, b) for role, a, b in self.roles})
        object.__setattr__(self, "token", re.compile("|".join(map(re.escape, longest))))
        object.__setattr__(self, "guarded", re.compile("|".join(rf"(?<={re.escape(m[0])})(?=\\*{re.escape(m[1:])})" for m in longest)))

    def escape(self, text: str) -> str:
        return self.guarded.sub(r"\\", text)

    def unescape(self, text: str) -> str:
        """Undo ``escape``: every mark with backslashes after its first character loses one."""
        if "\\" not in text:
            return text
        drop = {m.start() for m in self.guarded.finditer(text) if text[m.start()] == "\\"}
        return "".join(c for k, c in enumerate(text) if k not in drop) if drop else text

    def render(self, role: str, text: str, escaped: bool) -> tuple[str, int, int]:
        """A turn, and where its content begins and ends in it."""
        name, text = (self.escape(role), self.escape(text)) if escaped else (role, text)
        opening, closing = self.marks.get(role) or ("".join((self.name[0], name, self.name[1], self.other[0])), self.other[1])
        return f"{opening}{text}{closing}\n", len(opening), len(opening) + len(text)

    def parse(self, formatted: str) -> Iterator[tuple[str, str, int, int]]:
        """role, text, and where the content stands, for each turn; Malformed where the grammar doesn't go on."""
        at = 0

        def mark(anywhere: bool) -> re.Match:
            nonlocal at
            found = (self.token.search if anywhere else self.token.match)(formatted, at)
            if not found:
                raise Malformed(f"no mark at {at}")
            at = found.end()
            return found

        def content(closing: str) -> tuple[int, int]:
            start = at
            found = mark(True)
            if found.group() != closing:
                raise Malformed(f"{found.group()} at {found.start()} in place of {closing}")
            return start, found.start()

        while at < len(formatted):
            opening = mark(False).group()
            if opening == self.name[0]:
                a, b = content(self.name[1])
                role, closing = self.unescape(formatted[a:b]), self.other[1]
                if role in self.marks or mark(False).group() != self.other[0]:
                    raise Malformed(f"no text of a role at {at}")
            elif opening in self.by_open:
                role, closing = self.by_open[opening]
            else:
                raise Malformed(f"{opening} opens no turn")
            start, end = content(closing)
            if formatted[at : at + 1] != "\n":
                raise Malformed(f"no line feed at {at}")
            at += 1
            yield role, self.unescape(formatted[start:end]), start, end

    def read(self, formatted: str) -> list[Turn] | None:
        """The turns, or None where there are none to be read."""
        try:
            return [(role, text) for role, text, _, _ in self.parse(formatted)]
        except Malformed:
            return None

    def format(self, turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
        """A text that reads back as ``turns``, and where the learned contents stand in it.

        Turns are rendered as they are. If what is read back differs, those that don't
        read back alone are escaped; if it still differs, all are.
        """
        rendered = [self.render(*t, escaped=False) for t in turns]
        if self.read("".join(r for r, _, _ in rendered)) != turns:
            rendered = [r if self.read(r[0]) == [t] else self.render(*t, escaped=True) for t, r in zip(turns, rendered)]
            if self.read("".join(r for r, _, _ in rendered)) != turns:
                rendered = [self.render(*t, escaped=True) for t in turns]
                if self.read("".join(r for r, _, _ in rendered)) != turns:
                    raise Malformed("turns that no escaping makes readable")
        spans, at = [], 0
        for (role, _), (turn, start, end) in zip(turns, rendered):
            if role == self.learned:
                spans.append((at + start, at + end))
            at += len(turn)
        return "".join(r for r, _, _ in rendered), spans


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text in order: by conversation, turn, role and the text's hash, nulls first; null roles and texts are empty."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("mixed", F.xxhash64("text"))
    keys = ["conv_id", "turn", "role", "mixed"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")


def formatted(conversations: DataFrame, template: Template = Template(), piece: int = PIECE) -> DataFrame:
    """Pieces of whole turns of each conversation, in order of part and piece, each a sentence of the template's grammar.

    ``loss`` holds the spans of learned content (code points of the piece, end
    exclusive). ``first`` and ``last`` tell whether a task knows that a conversation
    begins or ends with the piece: at a task's edges it may go on in the next.

    Turns go by turn number, ties by role and then a hash of the text; rows that repeat
    are turns each. A null id is a conversation of its own; null roles and texts are
    empty. A text of any length is one turn, in one piece. No rows, no pieces. Other
    columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done, turns, now, size, held, made = [], [], None, 0, 0, 0
        # a task's first conversation may have begun before
        begins, seen = False, False

        def end(last: bool) -> None:
            nonlocal turns, size, made, begins
            text, spans = template.format(turns)
            done.append((now, part, made, text, [{"start": a, "end": b} for a, b in spans], begins, last))
            turns, size, made, begins = [], 0, made + 1, last

        for b in batches:
            for conv_id, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if seen and (conv_id != now or size >= piece):
                    end(conv_id != now)
                    if (held := held + len(done[-1][3])) >= piece or len(done) >= BATCH:
                        yield batch(done, PIECE_TYPES)
                        done, held = [], 0
                now, seen = conv_id, True
                turns.append((role, text))
                size += len(text)
        if seen:
            end(False)
            yield batch(done, PIECE_TYPES)

    return ordered(conversations).select("conv_id", "role", "text").mapInArrow(run, PIECES)


class Reader:
    """What is read back of one conversation, piece by piece."""

    def __init__(self, template: Template):
        self.template = template
        self.turns = self.chars = self.learned = 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str, loss: Iterable[dict[str, int]]) -> None:
        for role, text, _, _ in self.template.parse(formatted):
            self.turns += 1
            self.text.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = self.template.unescape(formatted[span["start"] : span["end"]])
            self.learned += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.turns, self.text.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


def digests(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """What each conversation's pieces read back as: counts of turns and of learned and all characters, and digests of turns and of learned text.

    A conversation that is one piece is read where it lies. Only pieces of others (long
    ones, and those at tasks' edges) move, and are read in order: a digest of one
    conversation can't be split, so its pieces pass through one task, which holds a
    batch of them. No pieces, no rows.
    """
    moved = "conv_id long, part int, piece long, formatted string, loss array<struct<start: long, end: long>>, " + ", ".join(c for c in DIGESTS.split(", ")[1:])
    kinds = PIECE_TYPES[:5] + DIGEST_TYPES[1:]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["first"] and r["last"]:
                    reader = Reader(template)
                    reader.read(r["formatted"], r["loss"])
                    rows.append((r["conv_id"], r["part"], r["piece"], None, None, *reader.row(None)[1:]))
                else:
                    rows.append((*(r[c] for c, _ in PIECE_TYPES[:5]), *[None] * 5))
            yield batch(rows, kinds)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if reader and (r["conv_id"] != now or r["formatted"] is None):
                    rows.append(reader.row(now))
                    reader = None
                if r["formatted"] is None:
                    rows.append(tuple(r[c] for c, _ in DIGEST_TYPES))
                else:
                    reader, now = reader or Reader(template), r["conv_id"]
                    reader.read(r["formatted"], r["loss"])
            yield batch(rows, DIGEST_TYPES)
        if reader:
            yield batch([reader.row(now)], DIGEST_TYPES)

    read = pieces.mapInArrow(alone, moved).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return read.mapInArrow(together, DIGESTS)
