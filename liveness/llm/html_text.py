"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. A line weighs as many characters as it
has outside links, lines of a named article (``article``, ``main``) more; menus, headers, footers
and forms weigh nothing. Weights are summed over sliding windows of lines; text is kept from
where the sums surge to where they dive. Where a named article holds the largest surge, lines
outside weigh nothing. Blocks whose class or id names an advert, comments and the like weigh
nothing either, unless their own text surges and outweighs the rest of the page."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Lines of a window, and the window's weight that makes a surge.
WINDOW, SURGE = 3, 86
#: Weight of a character outside links in a named article.
BONUS = 2

# ------------------------------------------------------------------ fixed values: elements and names

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section
summary table tbody td tfoot th thead tr ul""".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("""head script style noscript template svg math canvas iframe object audio video map select
button textarea title""".split())
#: Those of them whose content is not markup either.
RAW = frozenset("script style textarea title iframe noscript template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark a block as no part of the article.
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment
comments consent cookie cookies disqus dropdown footer footnav form header login masthead menu menus modal nav navbar
navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies
reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tagcloud teaser toolbar topbar
widget widgets""".split())
#: Those of them that never hold the story while there is other text: what readers or lawyers wrote, and adverts.
NEVER = frozenset("""ad ads adv advert adverts advertisement advertising adsense comment comments consent cookie cookies disqus
replies reply respond sponsor sponsored""".split())
#: A compound with one of these says what a block lacks, goes with or is filed under, not what it is.
MODIFIERS = frozenset("no not non without with has category tag tagged type format template".split())
#: Words that add nothing to a name before them: ad-slot is an ad, share-price no share.
PLAIN = frozenset("""area bar block body bottom box btn button buttons col column container content group holder icon
icons inner item items left link links list main outer panel placeholder right row section slot text title top unit wrap
wrapper zone""".split())
ARTICLE_NAMES = frozenset("articlebody".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*>""", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Za-z]+")


def _named(token: str) -> str:
    """The word of NAMES that a class or id is about, or "". Of a compound, its last word counts
    (cookie-notice), but for PLAIN ones after it (ad-slot)."""
    parts = _NAME.findall(token)
    if MODIFIERS.intersection(parts):
        return ""
    while len(parts) > 1 and parts[-1] in PLAIN:
        parts.pop()
    if not parts or parts[-1] not in NAMES:
        return ""
    return next((x for x in parts if x in NEVER), parts[-1])


def _role(tag: str, attributes: str, inside: bool) -> tuple[str, str]:
    """"article", "skip" (no text of the article) or "" of an element ``inside`` an article, and the
    word of NAMES it is called by, or ""."""
    called = ""
    article = tag in ("article", "main")
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if key in ("class", "id"):
            for name in map(_named, value.split()):
                called = name if name in NEVER else called or name
        elif key == "role":
            article |= value in ("main", "article")
            if value in ROLES:
                return "skip", ""
        elif key == "itemprop":
            article |= value in ARTICLE_NAMES
        elif value != "false":
            return "skip", ""  # hidden
    if tag in BOILERPLATE or tag == "header" and not inside:
        return "skip", ""
    return "article" if article else "", called if tag not in ("body", "html", "main") else ""


#: A line: text, characters inside links, boilerplate, number of the outermost article or 0, and the innermost
#: block around it that is called by a word of NAMES, as a place in the chain (0: none).
Line = tuple[str, int, bool, int, int]


class _Open:
    """The open elements. What the parser asks of them is kept in counts and short lists, so that no question
    walks the stack."""

    def __init__(self):
        self.stack: list[tuple[str, str, int]] = []   # name, role, place in the chain
        self.chain: list[tuple[int, str]] = [(0, "")]  # named blocks: the one around, the word
        self.count: Counter[str] = Counter()
        self.skip = self.article = self.aside = 0      # skipped elements, articles, skipped ones of BOILERPLATE
        self.flagged: list[int] = []                   # places in the stack of skipped or named elements

    def push(self, tag: str, role: str, called: str) -> None:
        around = self.stack[-1][2] if self.stack else 0
        if role == "skip" or called:
            self.flagged.append(len(self.stack))
        if called:
            self.chain.append((around, called))
            around = len(self.chain) - 1
        self.stack.append((tag, role, around))
        self.count[tag] += 1
        self.skip += role == "skip"
        self.aside += role == "skip" and tag in BOILERPLATE
        self.article += role == "article"

    def close(self, i: int) -> None:
        """Close the elements from place ``i`` on."""
        while len(self.stack) > i:
            tag, role, _ = self.stack.pop()
            self.count[tag] -= 1
            self.skip -= role == "skip"
            self.aside -= role == "skip" and tag in BOILERPLATE
            self.article -= role == "article"
            if self.flagged and self.flagged[-1] == len(self.stack):
                self.flagged.pop()

    def close_tag(self, tag: str) -> None:
        if self.count[tag]:  # a stray end tag closes nothing
            i = len(self.stack) - 1
            while self.stack[i][0] != tag:
                i -= 1
            self.close(i)


def lines(page: str) -> tuple[list[Line], list[tuple[int, str]]]:
    """The blocks with text, in page order, and the chain of named blocks: (place of the one around, word). White
    space is one blank; character references are decoded. Linear in the page: each tag is read once, and
    what is known not to follow is not looked for again."""
    out: list[Line] = []
    open_ = _Open()
    part = linked = at = 0
    words: list[str] = []
    state = (False, 0, 0)
    n, last_end = len(page), page.rfind(">")
    unclosed: set[str] = set()  # skipped elements of which no end tag follows

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            out.append((text, min(linked, len(text)), *state))
        words.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked, state
        stack = open_.stack
        if raw and not (stack and stack[-1][0] in SKIPPED):
            state = (open_.skip > 0, part if open_.article else 0, stack[-1][2] if stack else 0)
            text = html.unescape(raw)
            words.append(text)
            if open_.count["a"]:
                linked += len(text.strip())

    def end_of(tag: str, stop: str = "") -> int | None:
        """Where the next end tag of ``tag`` ends."""
        if tag in unclosed:
            return None
        m = re.compile(rf"</{tag}\b[^>]*>{stop}", re.I).search(page, at, last_end + 1)
        if m is None:
            unclosed.add(tag)
        return m and m.end()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt) if lt < last_end or page.startswith("<!--", lt) else None
        if m is None:  # a bare "<" is text, and so is all of what follows the last ">"
            later = -1 if lt < last_end else page.find("<!--", lt)  # an unclosed comment may still follow
            to = lt + 1 if lt < last_end else later if later >= 0 else n
            say(page[at:to])
            at = to
            continue
        say(page[at:lt])
        at = m.end()
        if m.lastindex is None or m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if tag in BLOCKS or tag in SKIPPED:
            flush()
        elif tag == "br":
            words.append(" ")
        if m.group(1):
            open_.close_tag(tag)
        elif tag in RAW:
            at = end_of(tag) or n
        elif tag in SKIPPED:
            at = end_of(tag, "|(?=<body\\b)" if tag == "head" else "") or at
        elif tag not in VOID and not m.group(3).rstrip().endswith("/"):
            role, called = _role(tag, m.group(3), open_.article > 0)
            if tag == "p" and open_.stack and open_.stack[-1][0] == "p":
                open_.close(len(open_.stack) - 1)
            if role == "article" and not called and not open_.aside and open_.flagged:
                open_.close(open_.flagged[0])  # an unclosed notice does not swallow the article that follows it
            part += role == "article" and not open_.article
            open_.push(tag, role, called)
    flush()
    return out, open_.chain


def _reach(weights: np.ndarray, window: int, least: int) -> np.ndarray:
    """Flags of the lines from a surge (a window's sum reaches ``least``) to the dive after it
    (a window's sum is 0)."""
    padded = np.concatenate([weights, np.zeros(window - 1, weights.dtype)])
    sums = np.convolve(padded, np.ones(window, weights.dtype), "valid") if len(weights) else weights
    keep, inside = np.zeros(len(weights), bool), False
    for i, s in enumerate(sums):
        inside = s > 0 if inside else s >= least
        keep[i] = inside
    return keep


def surges(weights: np.ndarray, window: int, least: int) -> np.ndarray:
    """The lines of ``_reach`` that have a weight."""
    return _reach(weights, window, least) & (weights > 0)


def main_text(page: str, window: int = WINDOW, least: int = SURGE) -> str:
    """The main text of a page: kept blocks joined by line feeds."""
    found, chain = lines(page)
    if not found:
        return ""
    weight = np.array([0 if skip else (len(text) - linked) * (BONUS if article else 1)
                       for text, linked, skip, article, _ in found], np.int64)
    skipped = _skipped(found, chain, weight, window, least)
    part = np.array([0 if skip else article for (*_, article, _), skip in zip(found, skipped)])
    size = np.where(skipped, 0, weight)
    keep = surges(size, window, least)
    if part.any() and _names_the_story(size * keep if keep.any() else size, part):
        inside = np.flatnonzero(part)  # skipped lines between are no dive
        size = size[inside]
        keep = np.zeros(len(found), bool)
        # from dive to dive: short lines before a surge belong to it, as do linked ones (headings) within
        keep[inside] = (_reach(size, window, least) | _reach(size[::-1], window, least)[::-1]) & ~_dives(size, window)
        if not keep.any():
            keep = part > 0
    elif not keep.any():  # a page too short to surge
        keep = size > 0
    return "\n".join(t for (t, *_), k in zip(found, keep) if k)


def _skipped(found: list[Line], chain: list[tuple[int, str]], weight: np.ndarray, window: int, least: int) -> np.ndarray:
    """Flags of boilerplate lines. A name is let go if the text of the blocks called by it surges and
    outweighs the surges of the rest; for NEVER ones, if nothing else surges."""
    skipped = np.array([skip for _, _, skip, _, _ in found])
    place = np.array([at for *_, at in found])
    if not place.any():
        return skipped
    free = place == 0
    text_of = lambda lines: np.where(lines & ~skipped, weight, 0)
    surging = lambda size: int(size[surges(size, window, least)].sum())
    rest = surging(text_of(free))
    called = np.array([word for _, word in chain])[place]
    own = {c: surging(text_of(called == c)) for c in sorted(set(called[~free].tolist()))}
    none = not text_of(free).any()  # then short texts count too
    gone = set()
    for c in sorted(own, key=lambda c: (c in NEVER, -own[c])):
        if own[c] and (rest == 0 if c in NEVER else own[c] > rest) or none and not rest and c not in NEVER:
            gone.add(c)
            rest += own[c]
    # a block counts if it and all named ones around it are let go; the chain lists outer ones first
    counts = [True] * len(chain)
    for i in range(1, len(chain)):
        around, word = chain[i]
        counts[i] = word in gone and counts[around]
    return skipped | ~np.array(counts)[place]


def _dives(weights: np.ndarray, window: int) -> np.ndarray:
    """Flags of the lines in a sequence of at least ``window`` lines without weight."""
    run = np.cumsum(np.concatenate([[0], np.diff((weights == 0).astype(int)) != 0]))
    return (weights == 0) & (np.bincount(run)[run] >= window)


def _names_the_story(weight: np.ndarray, part: np.ndarray) -> bool:
    """Whether an article holds the largest surge. Outside, a surge ends at an article or a dive."""
    here = np.flatnonzero((weight > 0) & (part == 0))
    if not len(here):
        return True
    breaks = np.cumsum((weight == 0) | (part > 0))  # equal for lines without a break between them
    return np.bincount(part, weight)[1:].max() >= np.bincount(breaks[here], weight[here]).max()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches, "html"):
        texts = [main_text(v.as_py() or "") for v in piece.column(2)]
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, ``text`` (main text, empty if none), ``n_chars`` (code points).

    Null or empty html gives an empty text; broken markup (unclosed, crossed or stray tags)
    is read as far as it goes; null ids and urls stay; repeated rows give equal rows; no rows
    give no rows. Other columns are not read. Pages are read whole, one pass, no shuffle."""
    return (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))
            .mapInArrow(_extract, "page_id long, url string, text string, n_chars long"))
