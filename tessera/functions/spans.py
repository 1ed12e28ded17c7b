"""Where things stand in a text: samples of what patterns match, in the text as it was written, and stretches to leave out.

Patterns read a normalised view. Beside it stands a sorted list of the places where the
view is longer or shorter than the text; a binary search takes a match back to the
stretch of the text that it was made of.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.regex import Pattern
from tessera.functions.text import compatibility

#: Samples that a rule shows, and matches that it counts, at most.
SAMPLES, MATCHES = 5, 500
BLANK = " \t\u00a0\u202f"
SAMPLED = "array<struct<rule: string, total: int, samples: array<string>, spans: array<struct<start: int, stop: int>>>>"
INTERVALS = "array<struct<start: int, stop: int>>"


@cache
def _changing() -> tuple[re.Pattern, re.Pattern, dict[str, str]]:
    """Runs of blanks and invisible letters, or another letter that isn't ASCII; what is invisible; and what letters become."""
    invisible = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), catalog.INVISIBLE)
    one, to, many = compatibility()
    inner = invisible.strip("[]").removesuffix("]+")
    return re.compile(f"[{BLANK}{inner}]+|[^\\x00-\\x7f]"), re.compile(f"[{inner}]"), dict(zip(catalog.CONFUSABLES[0] + one, catalog.CONFUSABLES[1] + to)) | many


class View:
    """A text's normalised form, and the way back from its places."""

    def __init__(self, text: str):
        changing, invisible, becomes = _changing()
        parts, at, length = [], 0, 0
        #: Of each change of length: where it begins and ends in the view, and in the text.
        self.begins, self.ends, self.first, self.last = [], [], [], []
        for m in changing.finditer(text):
            got = m[0]
            if got[0] in BLANK or invisible.match(got):
                blanks = [k for k, c in enumerate(got) if c in BLANK]
                new, first, last = (" ", m.start() + blanks[0], m.start() + blanks[-1] + 1) if blanks else ("", m.start(), m.end())
            else:
                new, first, last = becomes.get(got, got), m.start(), m.end()
            parts += (text[at : m.start()], new)
            length += m.start() - at
            if len(new) != len(got):
                self.begins.append(length)
                self.ends.append(length + len(new))
                self.first.append((first, last))
                self.last.append(m.end())
            length += len(new)
            at = m.end()
        self.text = "".join((*parts, text[at:]))

    def letter(self, at: int) -> tuple[int, int]:
        """The stretch of the text that the view's letter stands for."""
        k = bisect_right(self.begins, at) - 1
        if k < 0:
            return at, at + 1
        if at < self.ends[k]:
            return self.first[k]
        place = at - self.ends[k] + self.last[k]
        return place, place + 1

    def back(self, start: int, stop: int) -> tuple[int, int]:
        return self.letter(start)[0], self.letter(stop - 1)[1]


def found(text: str, patterns: dict[str, re.Pattern], most: int = SAMPLES) -> list[tuple[str, int, list[str], list[tuple[int, int]]]]:
    """Of each pattern with a match: its name, how many, the first distinct samples (case aside) as written, and where they stand."""
    view, out = View(text), []
    for rule, pattern in patterns.items():
        n, samples, spans, seen = 0, [], [], set()
        for m in pattern.finditer(view.text):
            n += 1
            if len(samples) < most and m.end() > m.start():
                a, b = view.back(*m.span())
                sample = text[a:b].strip()
                if sample and sample.lower() not in seen:
                    seen.add(sample.lower())
                    samples.append(sample)
                    spans.append((a, b))
            if n >= MATCHES:
                break
        if n:
            out.append((rule, n, samples, spans))
    return out


def samples(text: Column, patterns: dict[str, Pattern], most: int = SAMPLES) -> Column:
    """rule, total, samples and spans of every pattern that matches. A null text has none. Spans are code points of the text, ends exclusive."""
    compiled = {k: re.compile(p.source, re.ASCII | (re.IGNORECASE if p.ignore_case else 0)) for k, p in patterns.items()}
    kind = pa.list_(pa.struct([
        ("rule", pa.string()), ("total", pa.int32()), ("samples", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ]))

    @F.arrow_udf(SAMPLED)
    def read(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = [found(t or "", compiled, most) for t in part.to_pylist()]
            yield pa.array([[{"rule": r, "total": n, "samples": s, "spans": [{"start": a, "stop": b} for a, b in at]} for r, n, s, at in row] for row in rows], kind)

    return read(text)


def merged(spans: Column) -> Column:
    """Intervals (start, stop) in order, those that touch or lie in one another as one; empty ones are nothing."""
    none = F.array().cast(INTERVALS)

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["stop"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    own = F.transform(F.coalesce(spans, none), lambda s: F.struct(s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop")))
    return F.aggregate(F.array_sort(F.filter(own, lambda s: s["stop"] > s["start"])), none, step)


def without(text: Column, spans: Column, between: str = "\n\n") -> Column:
    """A text without some stretches of it, what is left joined by ``between``; blank rests are nothing."""
    cut = merged(spans)
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda s: s["stop"]))
    stops = F.concat(F.transform(cut, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.zip_with(starts, stops, lambda a, b: F.trim(F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))))
    return F.array_join(F.filter(kept, lambda p: p != ""), between)


def quotes(text: Column) -> Column:
    """Intervals of quotations: lines after ``>``, and what stands from an opening quotation mark to the mark that closes it.

    Curly marks nest; a straight mark opens where none is open and closes one that is.
    A quotation that is not closed ends with its line.
    """

    @F.arrow_udf(INTERVALS)
    def read(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for part in parts:
            yield pa.array([[{"start": a, "stop": b} for a, b in quoted_in(t or "")] for t in part.to_pylist()], kind)

    return read(text)


_MARK = re.compile("[\u201c\u201d\u201e\"\n]|(?m:^)[ \t]*>")


def quoted_in(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    opened: list[tuple[int, str]] = []
    for m in _MARK.finditer(text):
        mark = m[0][-1]
        if mark == "\n":
            out += [(a, m.start()) for a, _ in opened]
            opened = []
        elif mark == ">":
            opened.append((m.start(), ">"))
        elif mark in "\u201c\u201e":
            opened.append((m.start(), mark))
        elif mark == '"' and not (opened and opened[-1][1] == '"'):
            opened.append((m.start(), mark))
        elif opened and opened[-1][1] != ">":
            out.append((opened.pop()[0], m.end()))
    return out + [(a, len(text)) for a, _ in opened]
