"""Patterns written once, spelled for the engine that runs them.

A pattern is written with ASCII word boundaries and ``\\uXXXX`` escapes. Java's
``\\b`` takes accented letters for word characters, so it is spelled out there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it; engines' own ``\s`` leaves some of it out.
SPACES = r"\s\u00A0\uFEFF\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_WORD = "[A-Za-z0-9_]"
_BEFORE = f"(?<!{_WORD})"
_EITHER = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


@dataclass(frozen=True)
class Pattern:
    source: str
    ignore_case: bool = False
    #: For engines without look-around or back-references, where the source has any.
    plain: str | None = None
    #: Matches of this one are to be taken off the plain one's.
    except_plain: str | None = None
    #: Every match holds one of these (lower case, if case is ignored). Looking for them first is far cheaper.
    needles: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        """Boundaries before a letter only need to look back."""
        out = re.sub(r"\\b(?=(?:\(|\(\?:)?(?:[A-Za-z0-9]|\[[a-zA-Z]))", lambda _: _BEFORE, self.source)
        out = re.sub(r"(?<!\\)\\b", lambda _: _EITHER, out)
        return ("(?i)" if self.ignore_case else "") + out

    def _plain(self, text: str) -> str:
        out = re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", text)
        return ("(?i)" if self.ignore_case else "") + out

    def count(self, text: Column, low: Column | None = None) -> Column:
        """How many matches. ``low`` is the text in lower case; with it, texts without a needle aren't searched."""
        n = F.regexp_count(text, F.lit(self.java))
        if low is None or not self.needles:
            return n
        hay = low if self.ignore_case else text
        may = hay.contains(self.needles[0])
        for needle in self.needles[1:]:
            may = may | hay.contains(needle)
        return F.when(may, n).otherwise(0)

    def found(self, text: Column) -> Column:
        return text.rlike(self.java)

    def all(self, text: Column, group: int = 0) -> Column:
        return F.regexp_extract_all(text, F.lit(self.java), F.lit(group))

    def sql_count(self, text: str) -> str:
        """The same count in SQL over an engine of the RE2 kind."""
        got = f"len(regexp_extract_all({text}, {quoted(self._plain(self.plain or self.source))}))"
        if self.except_plain:
            got = f"({got} - len(regexp_extract_all({text}, {quoted(self._plain(self.except_plain))})))"
        return got

    def sql_found(self, text: str) -> str:
        return f"regexp_matches({text}, {quoted(self._plain(self.plain or self.source))})"

    def sql_all(self, text: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {quoted(self._plain(self.plain or self.source))}, {group})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def total(patterns: list[Pattern], text: Column, low: Column | None = None) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + p.count(text, low)
    return out


def sql_total(patterns: list[Pattern], text: str) -> str:
    return "(" + " + ".join(p.sql_count(text) for p in patterns) + ")"
