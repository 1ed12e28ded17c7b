"""Personal data, also in disguise: deobfuscate with offsets kept, detect, map back.

The base detectors read the text as it is. A chain of transducers then rewrites
look-alike letters and digits, spelled digits and written-out "at" and "dot",
and remembers for each character it makes which characters of the text it came
from. What the same detectors find in the rewritten text is mapped back, and
added unless a base span of its kind covers or crosses it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "all_email long, all_ip long, all_card long, all_phone long"
)
#: The base detectors. Runs are entered at their first character only, so long runs cost one pass.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Letters that look like Latin ones, in the order of their stand-ins.
LOOKALIKES = str.maketrans(
    "АВЕКМНОРСТХаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρıɡℓ",
    "ABEKMHOPCTXaeopcyxijshdqwABEZHIKMNOPTYXoavpigl",
)
UNSEEN = {0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}
DIGITS = {
    **{w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine".split())},
    **{w: str(k) for k, w in enumerate("null eins zwei drei vier fünf sechs sieben acht neun".split())},
    **{w: str(k) for k, w in enumerate("zéro un deux trois quatre cinq six sept huit neuf".split())},
    **{w: str(k) for k, w in enumerate("cero uno dos tres cuatro cinco seis siete ocho nueve".split())},
    "oh": "0",
}
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
#: At least two spelled digits in a row; "double" and "triple" are left alone.
SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD})(?:[\x20-]+(?:{_WORD}|[0-9]|dot|punkt|point|punto))+(?![^\W_])", re.I)
ONE_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD})(?![^\W_])", re.I)
PLUS = re.compile(r"(?<![^\W_])plus[\x20]+(?=[0-9])", re.I)
AT = re.compile(r"\s*[\[({<]\s*(?:at|@|arroba|chez)\s*[\])}>]\s*", re.I)
DOT = re.compile(r"\s*[\[({<]\s*(?:dot|\.|punkt|point|punto|period)\s*[\])}>]\s*", re.I)
_NAME = r"[A-Za-z0-9_%+-]+(?:(?:\.|[\x20]dot[\x20])[A-Za-z0-9_%+-]+)*"
#: Endings of hosts that written-out addresses are taken for.
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|me|tv|ai|app|dev|de|fr|es|uk|us|eu|it|nl|be|ch|at|pt|pl|ru|br|mx|ca|au|in|jp|cn|test|example"
#: "name at host dot com": both words are needed, and a known ending.
WRITTEN = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME}[\x20]+at[\x20]+[A-Za-z0-9-]+(?:(?:\.|[\x20]+dot[\x20]+)[A-Za-z0-9-]+)*[\x20]+dot[\x20]+(?:{ENDINGS})(?![A-Za-z0-9-])", re.I)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])[\x20]+@[\x20]*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[\x20]+(?=[A-Za-z0-9-]+\.[A-Za-z])")
DOTTED_NUMBERS = re.compile(r"(?<![^\W_])[0-9]{1,3}(?:[\x20]*(?:dot|punkt|point|punto)[\x20]*[0-9]{1,3}){3}(?![^\W_])", re.I)
#: A text whose lower case holds none of these has nothing to rewrite.
HINT_SIGNS = re.compile(r"[\[({<]\s*(?:at|@|dot|\.|arroba|chez|punkt|point|punto|period)\s*[\])}>]")
HINT_WORDS = (" dot ", " punkt ", " point ", " punto ", "plus ", " @", "@ ")
HINT_DIGITS = re.compile(rf"(?:{_WORD})[\x20-]+(?:{_WORD}|[0-9]|dot|punkt|point|punto)(?![^\W_])")
HINT_DOTTED = re.compile(r"[0-9][\x20]*(?:dot|punkt|point|punto)[\x20]*[0-9]")
ANY_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        # the run of name characters that ends at the sign, read backwards
        run = LOCAL.match(text[done:at][::-1])
        host = DOMAIN.match(text, at + 1) if run else None
        if host:
            yield at - run.end(), host.end()
            done = host.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, leftmost and non-overlapping; matches that fail a check are dropped, not retried."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    if not ANY_DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if len(m[0]) < 64 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdecimal() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


class View:
    """A rewritten text; character k came from the text's characters starts[k] to ends[k]."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, given in order, by strings; each character made stands for the whole span."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, made in edits:
            text += [self.text[at:a], made]
            starts += self.starts[at:a] + [self.starts[a]] * len(made)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(made)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def back(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _plain(c: str) -> str:
    """What one character looks like: nothing if unseen, else its compatibility form and Latin look-alike."""
    if ord(c) in UNSEEN:
        return ""
    known = c.translate(LOOKALIKES)
    if known != c:
        return known
    folded = unicodedata.normalize("NFKC", c)
    if len(folded) == 1 and folded.isascii() and not folded.isspace():
        return folded
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    return c


_SEEN: dict[str, str] = {}


def _lookalikes(view: View) -> None:
    strange = {c for c in set(view.text) if not c.isascii()}
    change = {c: p for c in strange if (p := _SEEN.setdefault(c, _plain(c))) != c}
    if len(_SEEN) > 20000:
        _SEEN.clear()
    if change:
        pattern = re.compile("[" + "".join(map(re.escape, change)) + "]")
        view.rewrite([(m.start(), m.end(), change[m[0]]) for m in pattern.finditer(view.text)])


def _spelled(view: View) -> None:
    edits = []
    for m in SPELLED.finditer(view.text):
        last = None
        for d in ONE_SPELLED.finditer(view.text, m.start(), m.end()):
            # spaces and hyphens between two digits go with the second
            a = d.start()
            if last is not None and not view.text[last:a].strip(" -"):
                a = last
            edits.append((a, d.end(), DIGITS[d[0].lower()]))
            last = d.end()
    view.rewrite(edits)
    view.rewrite([(m.start(), m.end(), "+") for m in PLUS.finditer(view.text)])


def _signs(view: View) -> None:
    view.rewrite([(m.start(), m.end(), "@") for m in AT.finditer(view.text)])
    view.rewrite([(m.start(), m.end(), ".") for m in DOT.finditer(view.text)])
    view.rewrite([(m.start(), m.end(), "@") for m in SPACED_AT.finditer(view.text)])
    edits = []
    for m in WRITTEN.finditer(view.text):
        for w in re.finditer(r"[\x20]+(at|dot)[\x20]+", m[0], re.I):
            edits.append((m.start() + w.start(), m.start() + w.end(), "@" if w[1].lower() == "at" else "."))
    view.rewrite(edits)
    edits = []
    for m in DOTTED_NUMBERS.finditer(view.text):
        for w in re.finditer(r"[\x20]*(?:dot|punkt|point|punto)[\x20]*", m[0], re.I):
            edits.append((m.start() + w.start(), m.start() + w.end(), "."))
    view.rewrite(edits)


def hinted(low: str) -> bool:
    """Whether an edit of ``_spelled`` or ``_signs`` may apply: each of their patterns needs one of the hints."""
    return any(w in low for w in HINT_WORDS) or any(h.search(low) for h in (HINT_SIGNS, HINT_DIGITS, HINT_DOTTED))


def disguised(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Base spans and those that only the rewritten text shows, by kind, in order."""
    strange = not text.isascii() and any(_SEEN.setdefault(c, _plain(c)) != c for c in set(text) if not c.isascii())
    if not strange and not hinted(text.lower()):
        return base
    view = View(text)
    if strange:
        _lookalikes(view)
    _spelled(view)
    _signs(view)
    out = {}
    for kind, spans in detect(view.text).items():
        merged = sorted(base[kind])
        for span in spans:
            a, b = view.back(*span)
            met = [m for m in base[kind] if m[0] < b and a < m[1]]
            # a wider span than a base one is added beside it; parts of base spans are not
            if all(a <= x and y <= b and (a, b) != (x, y) for x, y in met):
                merged.append((a, b))
        merged.sort()
        out[kind] = merged
    return out


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def personal_data(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: counts and digest of the base spans, all spans, and counts of all spans.

    Offsets are code points of the whole text, ends exclusive. A null text is empty; an
    empty text has no spans, and the digest of nothing. Rows that repeat are read each.
    No documents, no rows. Other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                base = detect(text)
                both = disguised(text, base)
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                out.append((doc_id, *(len(base[k]) for k in KINDS), digest, listed(both), *(len(both[k]) for k in KINDS)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield frame.assign(doc_id=b["doc_id"].astype("Int64").to_numpy())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, SCHEMA)
