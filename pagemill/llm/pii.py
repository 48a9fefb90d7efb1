"""Personal data in plain and disguised form, with offsets in the source text.

Plain identifiers are found in the text as it stands. For disguised ones two transducers rewrite it and keep, for every
character they write, the source characters it stands for: the first folds look-alike characters, digits of other scripts,
dashes, blanks, invisible marks and character entities; the second turns spelled digits into digits, closes up separated letters
around an at sign, and then turns at/dot disguises into their signs. The same detectors then run over the rewritten text, and
their spans are mapped back.

One pass over each text, no shuffle. Detectors are linear in the text's length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, slices, with_fields

KINDS = ("email", "ip", "card", "phone")

# Letters that look like a Latin one, in pairs of source and target.
LOOKALIKES = dict(
    zip(
        "аеорсхуіјѕһԁԛԝкАВЕКМНОРСТХУІЈЅοανιρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ",
        "aeopcxyijshdqwkABEKMHOPCTXYIJSoavipukABEZHIKMNOPTYXig",
        strict=True,
    )
)
# The digits 0 to 9 as spelled in four languages.
SPELLED = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGIT = {w: str(i) for line in SPELLED for i, w in enumerate(line.split())} | {"oh": "0"}
#: Digits of a spelled number at least and at most: a phone's or a card's.
REACH = (8, 19)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = "|".join(sorted(DIGIT, key=len, reverse=True))
_TOKEN = rf"(?:(?:{_WORD})(?![^\W_])|[0-9]+(?![^\W_]))"
_GAP = r"(?:,? {1,3}|,| ?- ?)"
NUMBER = re.compile(rf"(?<![^\W_])(?:plus[ -]{{1,2}}|\+ ?)?{_TOKEN}(?:{_GAP}{_TOKEN}){{3,}}", re.I)
PART = re.compile(rf"(?P<plus>plus[ -]{{1,2}}|\+ ?)|(?P<word>{_WORD})(?![^\W_])|(?P<digits>[0-9]+)|(?P<gap>{_GAP})", re.I)
_OPEN, _CLOSE = r"[ ]{0,2}[(\[{<][ ]{0,2}", r"[ ]{0,2}[)\]}>][ ]{0,2}"
_AT, _DOT = r"(?:at|arroba|arobase|ät)", r"(?:dot|punkt|punto|point)"
SIGN = re.compile(rf"{_OPEN}(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.)){_CLOSE}", re.I)
_SEP_AT, _SEP_DOT = rf"(?: {_AT} |_{_AT}_)", rf"(?: {_DOT} |_{_DOT}_)"
SAID_AT = re.compile(rf"{_SEP_AT}|@", re.I)
SAID_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:(?:{_SEP_DOT}|\.)[A-Za-z0-9-]++)++", re.I)
SAID_DOT = re.compile(_SEP_DOT, re.I)
LOCAL_CHAR = re.compile("[A-Za-z0-9_%+-]")
# Words before a spoken "at" that tell a place or time and are no one's name.
PLACES = frozenset("look looking looks looked me us you him her them it here there is are was were be been being am meet meeting met arrive arrived arrives stay staying live living work working worked stop stopped aim aimed sit sitting stand standing start starting end ending open opens close closes not good bad best laugh shout smile stare point happen happened held hold sold found available only still and or but especially usually also".split())
ENTITY = re.compile(r"&(?:#(?P<dec>[0-9]{2,3})|#[xX](?P<hex>[0-9A-Fa-f]{2})|(?P<name>commat|period|hyphen|plus|nbsp));")
# Character entities by name.
ENTITIES = {"commat": "@", "period": ".", "hyphen": "-", "plus": "+", "nbsp": " "}
SAID_IP = re.compile(rf"[0-9]{{1,3}}(?:(?: {_DOT} |\.)[0-9]{{1,3}}){{3}}", re.I)
_PART = rf"{_TOKEN}(?:[ -]{_TOKEN}){{0,2}}"
SPELLED_IP = re.compile(rf"(?<![^\W_]){_PART}(?: {_DOT} {_PART}){{3}}", re.I)
SAID_SIGN = re.compile(rf"[ _](?:(?P<at>{_AT})|(?P<dot>{_DOT}))[ _]", re.I)
SAYS = re.compile(_SEP_DOT, re.I)
SPACED_DOT = re.compile(rf" {_DOT} ", re.I)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost matches: for each sign the whole run of local characters before it."""
    done, at = 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > done and t[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(t, at) if lo < at else None
        if m:
            yield lo, m.end()
        done = m.end() if m else at + 1
        at = t.find("@", done)


def detect(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of plain identifiers, by kind, then start. Matches that fail a check are dropped."""
    out = [(0, *s) for s in _emails(t)]
    for m in IP.finditer(t):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in t:
        out += [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


@lru_cache(1 << 14)
def fold(c: str) -> str:
    """What a character looks like, or itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind in ("Cf", "Mn", "Me"):
        return ""
    if kind == "Pd" or c == "−":
        return "-"
    if kind == "Zs":
        return " "
    if len(n := unicodedata.normalize("NFKC", c)) == 1 and n < "\x80":
        return n
    return "." if c in "。｡․·" else c


def _odd() -> re.Pattern:
    """Every character that fold may change: the odd ones below U+0250 by name, and all from there on."""
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x80, 0x250)) if fold(c) != c) + "ɐ-\U0010ffff]")


ODD = _odd()


class Tape:
    """A rewritten text; edits are (start, end, replacement) in source offsets, in order and apart."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]], below: Tape | None = None):
        self.below, parts, at, size = below, [], 0, 0
        self.cuts: list[tuple[int, int, int, int]] = []  # written start and end, source start and end
        for x, y, new in edits:
            parts += [source[at:x], new]
            size += x - at
            self.cuts.append((size, size + len(new), x, y))
            size += len(new)
            at = y
        self.text = "".join([*parts, source[at:]])

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a written span, and whether it holds an edit."""
        i = bisect_right(self.cuts, (start, 1 << 62)) - 1
        lo, touched = start, False
        if i >= 0:
            a, b, x, y = self.cuts[i]
            lo = x if start < b else y + start - b
        j = bisect_right(self.cuts, (end - 1, 1 << 62)) - 1
        hi = end
        if j >= 0:
            a, b, x, y = self.cuts[j]
            hi = y if end - 1 < b else y + end - b
        touched = any(lo <= x and y <= hi for _, _, x, y in self.cuts[max(i, 0) : j + 1])
        if self.below:
            lo, hi, more = self.below.back(lo, hi)
            touched |= more
        return lo, hi, touched


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits in order, without those that begin within an earlier one."""
    out, at = [], 0
    for e in sorted(set(edits)):
        if e[0] >= at:
            out.append(e)
            at = e[1]
    return out


def _spelled(t: str) -> list[tuple[int, int, str]]:
    """Edits that make spelled digits digits, in numbers with as many digits as a phone or card and in addresses."""
    edits = []
    for run in NUMBER.finditer(t):
        found = list(PART.finditer(t, *run.span()))
        words = [DIGIT[m["word"].lower()] for m in found if m["word"]]
        groups = [m["digits"] for m in found if m["digits"]]
        if len(words) < 3 or len({*words, *groups}) < 2:  # one word said over and over is no number
            continue
        digits = len(words) + sum(map(len, groups))
        if not REACH[0] <= digits <= REACH[1]:
            continue
        for m in found:
            new = "+" if m["plus"] else DIGIT[m["word"].lower()] if m["word"] else m[0] if m["digits"] or m[0] == "-" else " "
            if new != m[0]:
                edits.append((m.start(), m.end(), new))
        if run[0][0] not in "+pP" and digits <= 15 and t[run.start() - 1 : run.start()] != "+":
            edits.append((run.start(), run.start(), "+"))
    if SAYS.search(t):
        for run in SPELLED_IP.finditer(t):
            at = run.start()
            for part in re.split(rf"( {_DOT} )", run[0], flags=re.I):
                if not SPACED_DOT.fullmatch(part):
                    edits += [(at + m.start(), at + m.end(), DIGIT[m["word"].lower()] if m["word"] else "") for m in PART.finditer(part) if not m["digits"]]
                at += len(part)
    return _apart(edits)


def _local_start(t: str, at: int, least: int) -> int:
    """Where the first part of a spoken address that ends at ``at`` begins: runs of its characters with dots between."""
    lo = at
    while True:
        x = lo
        while x > least and LOCAL_CHAR.match(t, x - 1):
            x -= 1
        if x == lo:
            return lo
        lo = x
        if x > least and t[x - 1] == ".":
            x -= 1
        elif dot := next((m for n in (5, 7) if x >= least + n and (m := SAID_DOT.fullmatch(t, x - n, x))), None):  # dot; punkt, punto, point
            x = dot.start()
        if x == lo or x <= least or not LOCAL_CHAR.match(t, x - 1):
            return lo
        lo = x


def _said(t: str) -> list[tuple[int, int]]:
    """Addresses with at least one spoken dot."""
    out, done = [], 0
    for m in SAID_AT.finditer(t):
        if m.start() < done or not (to := SAID_DOMAIN.match(t, m.end())):
            continue
        lo = _local_start(t, m.start(), done)
        if lo == m.start() or not SAID_DOT.search(t, lo, to.end()):
            continue
        if m[0] != "@" and t[lo : m.start()].lower() in PLACES:
            continue
        out.append((lo, to.end()))
        done = to.end()
    return out


def _signs(t: str) -> list[tuple[int, int, str]]:
    """Edits that make disguised at and dot their signs."""
    edits = []
    if any(x in t for x in "([{<"):  # SIGN begins with one of these
        edits += [(m.start(), m.end(), "@" if m["at"] else ".") for m in SIGN.finditer(t)]
    if SAYS.search(t):
        for lo, hi in [*_said(t), *(m.span() for m in SAID_IP.finditer(t))]:
            edits += [(m.start(), m.end(), "@" if m["at"] else ".") for m in SAID_SIGN.finditer(t, max(0, lo - 1), hi)]
    return _apart(edits)


def _separated(t: str) -> list[tuple[int, int, str]]:
    """Edits that close up addresses whose characters stand apart, as in a @ b . c o m."""
    edits, done, at = [], 0, t.find(" @ ")
    while at >= 0:
        lo, hi = at, at + 3
        while lo > done and t[lo - 1] in LOCAL and (lo - 1 == 0 or t[lo - 2] == " "):
            lo -= 2
        lo = max(lo + 1, 0) if lo < at else at
        while hi < len(t) and t[hi] in LOCAL and (hi + 1 == len(t) or t[hi + 1] in " ,;:!?\n"):
            hi += 2
            if hi - 1 < len(t) and t[hi - 1] != " ":
                break
        hi = min(hi - 1, len(t))
        if lo < at and hi > at + 3 and "." in t[at + 3 : hi]:
            edits += [(i, i + 1, "") for i in range(lo, hi) if t[i] == " "]
            done = hi
        at = t.find(" @ ", max(at + 1, hi - 1))
    return edits


def disguised(t: str) -> list[tuple[int, int, int]]:
    """Spans that only the rewritten text shows."""
    tape, edits = None, []
    if ODD.search(t):
        edits += [(m.start(), m.end(), f) for m in ODD.finditer(t) if (f := fold(m[0])) != m[0]]
    if "&" in t:
        for m in ENTITY.finditer(t):
            c = ENTITIES[m["name"]] if m["name"] else chr(int(m["dec"]) if m["dec"] else int(m["hex"], 16))
            if " " <= c <= "~":
                edits.append((*m.span(), c))
    if edits:
        tape = Tape(t, sorted(edits))
    for rewrite in (_spelled, _separated, _signs):
        now = tape.text if tape else t
        if edits := rewrite(now):
            tape = Tape(now, edits, tape)
    out = []
    for kind, x, y in detect(tape.text) if tape else ():
        lo, hi, touched = tape.back(x, y)
        if touched:
            out.append((kind, lo, hi))
    return out


def spans(t: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and those that rewriting adds; none of these lies within a plain span of its kind."""
    if not t:
        return [], []
    plain = detect(t)
    starts, ends = ([[s[i] for s in plain if s[0] == kind] for kind in range(len(KINDS))] for i in (1, 2))

    def within(kind: int, x: int, y: int) -> bool:
        i = bisect_right(starts[kind], x) - 1
        return i >= 0 and y <= ends[kind][i]

    return plain, [s for s in disguised(t) if not within(*s)]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))
    for b in slices(batches):
        rows = []
        for t in b.column("text").to_pylist():
            plain, more = spans(t)
            rows.append([{"kind": KINDS[k], "start": x, "end": y, "added": a} for k, x, y, a in sorted({(*s, False) for s in plain} | {(*s, True) for s in more})])
        yield b.append_column("spans", pa.array(rows, kind))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds spans: an array of (kind, start, end, added) by kind as in KINDS, then start; code points, end exclusive.

    Plain spans have added = false. Null and empty texts give an empty array. Repeated rows are treated alike; an empty
    table stays empty; other columns of any type and name stay, but a column named spans is replaced.
    """
    carried = Carried(docs, "spans", text=text)
    schema = with_fields(carried.frame, "spans array<struct<kind string, start int, end int, added boolean>>")
    return carried.frame.mapInArrow(_find, schema).select(*carried.columns(), "spans")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span in the text by its kind in angle brackets; overlapping spans of a text become one.

    Null texts stay null and empty ones empty. Repeated rows are treated alike; an empty table stays empty; other columns of
    any type and name stay as they are.
    """

    carried = Carried(docs, text=text)
    return carried.frame.mapInArrow(_mask, carried.frame.schema).select(*carried.columns())


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out = []
        for t in b.column("text").to_pylist():
            if t:
                plain, more = spans(t)
                parts, at = [], 0
                for x, y, kind in sorted((x, y, k) for k, x, y in plain + more):
                    if x >= at:
                        parts += [t[at:x], f"<{KINDS[kind]}>"]
                    at = max(at, y)
                t = "".join([*parts, t[at:]])
            out.append(t)
        i = b.schema.get_field_index("text")
        yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))


def digest(found: DataFrame) -> DataFrame:
    plain = F.filter("spans", lambda s: ~s["added"])
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = [F.expr(f"cast(size(filter(spans, s -> not s.added and s.kind = '{k}')) as long) n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(line(plain), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
