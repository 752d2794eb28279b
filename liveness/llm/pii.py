"""Personal data, plain and disguised, with spans in the source text.

Plain identifiers are matched in the text as it is. Then transducers rewrite disguises -
look-alike characters, spelled digits, "at" and "dot" in brackets or as words - and keep,
for every character they put out, the source characters it stands for. Identifiers found in
the rewritten text are mapped back over those."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, utf8

KINDS = ("email", "ip", "card", "phone")

# ------------------------------------------------------------------ fixed values: look-alikes

#: Letters of other scripts that look like the ASCII letter below them.
_CYRILLIC = "аеорсхуіјѕһԁԛԝАВЕКМНОРСТХУІЈЅ"
_CYRILLIC_AS = "aeopcxyijshdqwABEKMHOPCTXYIJS"
_GREEK = "οανιρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_GREEK_AS = "oavipukABEZHIKMNOPTYX"
#: Other signs read as @ . + - and blank.
_SIGNS = {"@": "﹫", ".": "․。｡﹒", "+": "﹢", "-": "‐‑‒–—−﹣", " ": "      　"}
#: Characters without width, which are dropped.
_ZERO_WIDTH = "­​‌‍⁠﻿"
#: Decimal digits of other scripts, by their zero.
_ZEROS = "٠۰०০०๐"

_LOOKS = {ord(c): a for c, a in zip(_CYRILLIC + _GREEK, _CYRILLIC_AS + _GREEK_AS)}
_LOOKS |= {ord(c): a for a, cs in _SIGNS.items() for c in cs}
_LOOKS |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full width
_LOOKS |= {ord(z) + i: str(unicodedata.decimal(chr(ord(z) + i))) for z in _ZEROS for i in range(10)}
_LOOK = re.compile("[" + re.escape("".join(map(chr, _LOOKS))) + _ZERO_WIDTH + "]")
_WIDTHLESS = re.compile("[" + _ZERO_WIDTH + "]")

# ------------------------------------------------------------------ fixed values: words

DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
          "seven": "7", "eight": "8", "nine": "9"}
AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "punkt", "punto", "point")

#: Last labels of domains before which a bare "at" may be that of an address.
DOMAINS = frozenset("com org net edu gov info biz io dev app ai co uk de fr es it nl eu ch at be pl se us ca au in jp br".split())
#: Words that announce an address.
_CUE = re.compile(r"(?:e-?mail|mail|contact|write|reach|address|adresse|correo|kontakt)[\w ]{0,6}[\s:=]+$", re.I)

_AT, _DOT, _DIGIT = "|".join(AT_WORDS), "|".join(DOT_WORDS), "|".join(DIGITS)
_BRACKET_AT = re.compile(rf"\s*(?:[\[({{<]\s*(?:{_AT}|@)\s*[\])}}>]|&#0*64;|&#x0*40;|&commat;|%40)\s*", re.I)
_BRACKET_DOT = re.compile(rf"\s*(?:[\[({{<]\s*(?:{_DOT}|\.)\s*[\])}}>]|&#0*46;|&#x0*2e;|&period;)\s*", re.I)
_WORD_AT = re.compile(rf"\s+(?:{_AT})\s+|@", re.I)
_WORD_DOT = re.compile(rf"\s+(?:{_DOT})\s+", re.I)
_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:(?:\s+(?:{_DOT})\s+|\.)[A-Za-z0-9-]+)+", re.I)
#: A number of spelled and written digits, with spelled dots between them.
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\s-]+)?(?:{_DIGIT}|[0-9]++)(?:[\s,-]+(?:{_DIGIT}|{_DOT}|[0-9]++))*[\s,-]+(?:{_DIGIT}|[0-9]++)(?![A-Za-z0-9])", re.I)
_TOKEN = re.compile(r"[a-z]+|[0-9]+", re.I)
#: Spelled digits that make a number one that is rewritten; or three spelled dots, as an address has.
_LEAST_SPELLED, _LEAST_DOTS = 2, 3
#: A bare "at" before something like a domain.
_MAYBE_AT = re.compile(rf"[A-Za-z0-9._%+-]\s+(?:{_AT})\s+[A-Za-z0-9-]+\.[A-Za-z]".encode(), re.I)
#: Cheap signs (lower-case) that words above may occur. "one" and "oh" alone spell no identifier.
_HINTS = [w.encode() for w in (*DOT_WORDS, "two", "three", "four", "five", "six", "seven", "eight", "nine", "zero")]

# ------------------------------------------------------------------ plain identifiers

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its first digit fails from the others, so it is tried once
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses. Each @ is met once: the local part is the
    longest run before it that no earlier match has taken."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        m = _HOST.match(text, at) if left < at else None
        if m:
            found.append((left, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain identifiers, by kind as listed, then start."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", *m.span()))
    return found


# ------------------------------------------------------------------ transducers

class Rewritten:
    """A text with, for each character, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace each (start, end) by one character, or by nothing. Edits are in sequence, apart."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for lo, hi, put in edits:
            text += [self.text[at:lo], put]
            start += self.start[at:lo]
            end += self.end[at:lo]
            if put:
                start.append(self.start[lo])
                end.append(self.end[hi - 1])
            at = hi
        self.text = "".join([*text, self.text[at:]])
        self.start = start + self.start[at:]
        self.end = end + self.end[at:]


def _fold(r: Rewritten) -> None:
    r.edit([(*m.span(), "") for m in _WIDTHLESS.finditer(r.text)])
    r.text = r.text.translate(_LOOKS)  # one character for one


def _brackets(r: Rewritten) -> None:
    r.edit([(*m.span(), "@") for m in _BRACKET_AT.finditer(r.text)])
    r.edit([(*m.span(), ".") for m in _BRACKET_DOT.finditer(r.text)])


def _digits(r: Rewritten) -> None:
    edits = []
    for m in _SPELLED.finditer(r.text):
        tokens = [(t.start(), t.end(), t.group().lower()) for t in _TOKEN.finditer(r.text, m.start(), m.end())]
        if (sum(w in DIGITS for *_, w in tokens) < _LEAST_SPELLED) and sum(w in DOT_WORDS for *_, w in tokens) < _LEAST_DOTS:
            continue
        at, before = m.start(), ""
        for start, end, word in tokens:
            if word.isdigit():
                # written digits keep what is between them; after a word they follow at once
                if before and not before.isdigit() and at < start:
                    edits.append((at, start, ""))
            else:
                # a digit takes the separators before it along, so that neighbours stand together
                edits.append((at, end, "+" if word == "plus" else DIGITS.get(word, ".")))
            at, before = end, word
    r.edit(edits)


def _local_dots(text: str, at: int) -> list[tuple[int, int]]:
    """Spelled dots inside the local part that ends at ``at``."""
    dots = []
    while True:
        left = at
        while left and text[left - 1] in _LOCAL:
            left -= 1
        stop = left
        while stop and text[stop - 1].isspace():
            stop -= 1
        word = next((w for w in DOT_WORDS if text[max(0, stop - len(w)):stop].lower() == w), None)
        if left == at or stop == left or word is None:
            return dots[::-1]
        first = stop - len(word)
        before = first
        while before and text[before - 1].isspace():
            before -= 1
        if before == first or not before or text[before - 1] not in _LOCAL:
            return dots[::-1]
        dots.append((before, left))
        at = before


def _plain_at(text: str, at: int, host: re.Match) -> bool:
    """Is the bare "at" at ``at`` that of an address: before a known domain, and after a name of several
    parts or with a digit, or after a word that announces an address?"""
    if host.group().rpartition(".")[2].lower() not in DOMAINS:
        return False
    left = at
    while left and text[left - 1] in _LOCAL:
        left -= 1
    name = text[left:at]
    return bool(re.search(r"[A-Za-z0-9][._+-][A-Za-z0-9]|[0-9]", name)) or bool(_CUE.search(text, max(0, left - 24), left))


def _words(r: Rewritten) -> None:
    """"name at host dot tld": a bare "at" counts before a domain with a spelled dot, after a name with
    one, or between a name and a domain that look like an address (``_plain_at``)."""
    edits, done = [], 0
    for m in _WORD_AT.finditer(r.text):
        if m.start() <= done or r.text[m.start() - 1] not in _LOCAL:
            continue
        host = _DOMAIN.match(r.text, m.end())
        if host is None:
            continue
        right = [d.span() for d in _WORD_DOT.finditer(r.text, host.start(), host.end())]
        left = [d for d in _local_dots(r.text, m.start()) if d[0] >= done]
        if right or left or m.group() != "@" and _plain_at(r.text, m.start(), host):
            edits += [(*d, ".") for d in left] + [(*m.span(), "@")] + [(*d, ".") for d in right]
            done = host.end()
    r.edit(edits)


def disguised(text: str, plain: list[tuple[str, int, int]], looks: bool, signs: bool, hints: bool) -> list[tuple[str, int, int]]:
    """Spans in ``text`` of identifiers that appear only after rewriting; spans inside a
    plain one of their kind are left out. The flags say which disguises may occur."""
    r = Rewritten(text)
    if looks and _LOOK.search(text):
        _fold(r)
    if signs:
        _brackets(r)
    if hints or (looks and r.text is not text):
        _digits(r)
        _words(r)
    if r.text == text:
        return []
    found = {(k, r.start[s], r.end[e - 1]) for k, s, e in identifiers(r.text)}
    # the plain ones of a kind are apart and in sequence, so one of them alone can hold a span
    begins = {k: [s for p, s, _ in plain if p == k] for k in KINDS}
    ends = {k: [e for p, _, e in plain if p == k] for k in KINDS}
    return [(k, s, e) for k, s, e in found if not ((i := bisect_right(begins[k], s)) and e <= ends[k][i - 1])]


# ------------------------------------------------------------------ over a table

_MARK = np.zeros(256, np.uint8)
_MARK[ord("@")] = _MARK[48:58] = 1                      # identifiers have an @ or digits
_MARK[[ord(c) for c in "[({<&%"]] = 2                    # brackets and character references
_MARK[0xC2:0xF5] = 4                                     # lead bytes; narrowed below
_MARK[0xC3:0xCE] = 0                                     # Latin letters have no look-alikes here


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches, "text"):
        data, off = utf8(piece.column(1))
        n = piece.num_rows
        marks = np.zeros(n, np.uint8)
        full = np.flatnonzero(np.diff(off))
        if len(full):
            marks[full] = np.bitwise_or.reduceat(_MARK[data], off[full])
        plain, every, total, counts = [], [], [], np.zeros((n, 4), np.int64)
        for i in range(n):
            raw = data[off[i]:off[i + 1]].tobytes()
            low = raw.lower()
            hints = any(h in low for h in _HINTS) or _MAYBE_AT.search(raw) is not None
            base, more = [], []
            if marks[i] or hints:
                text = raw.decode()
                base = identifiers(text) if marks[i] & 1 else []
                if hints or marks[i] & 6:
                    more = disguised(text, base, bool(marks[i] & 4), bool(marks[i] & 6), hints)
            for k, _, _ in base:
                counts[i, KINDS.index(k)] += 1
            plain.append(",".join(f"{k}:{s}:{e}" for k, s, e in base))
            both = sorted({*base, *more}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
            every.append(",".join(f"{k}:{s}:{e}" for k, s, e in both))
            total.append(len(both))
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), *(pa.array(counts[:, k]) for k in range(4)), pa.array(plain, pa.string()), pa.array(every, pa.string()),
             pa.array(total, pa.int64())],
            names=["id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_all"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, counts of plain identifiers (n_email, n_ip, n_card,
    n_phone), ``base`` (their spans), ``spans`` (all spans, disguised ones too), ``n_all`` (how many those are).

    Spans are ``kind:start:end`` in code points of the source text, end exclusive, by kind as
    listed, then start, comma-joined. A null or empty text has none; null ids stay; repeated
    rows give equal rows; no rows give no rows. Other columns are not read. Texts are read
    whole, one pass, no shuffle."""
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .withColumn("id", F.col("id").cast("long"))
            .mapInArrow(_find, "id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_all long")
            .withColumnRenamed("id", id_col))
