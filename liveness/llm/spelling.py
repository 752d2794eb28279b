"""Spelling variants of a corpus's words, found with a bit-sliced position index.

For every (position, letter) one bitset tells which words of the vocabulary have that letter
there. A word is matched against all of them at once: sets with no error and with one error
(a replaced, an extra, a missing letter, by positions shifted by one) move along its letters."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_count, shuffle_partitions, stage, whole_groups

#: Words of one index; a bucket with more is split, and every part is asked by every part.
BLOCK = 4096
#: Different words a task counts before it sends them on.
HELD = 1 << 18
#: Characters of a text that are taken at once (to the end of the run there).
_PIECE = 1 << 22

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_OUTSIDE = re.compile("[^a-zÀ-ÿ]")


# ------------------------------------------------------------------ counting

def runs(text: str, least: int) -> Counter:
    """Counts of the runs of letters (A-Z lower-cased; \\u00C0 to \\u00FF as they are) of ``least`` characters or more."""
    found: Counter = Counter()
    run = re.compile("[a-zÀ-ÿ]{%d,}" % least)
    at = 0
    while at < len(text):
        cut = _OUTSIDE.search(text, at + _PIECE) if len(text) - at > _PIECE else None
        to = cut.start() if cut else len(text)
        found.update(run.findall(text, at, to))
        at = to
    return found


def misspell(run: str, start: int, one_in: int) -> str:
    """``run``, or for one in ``one_in`` of them the run without one character. ``start`` is
    the CRC-32 of what stands before the run in the hashed text."""
    h = zlib.crc32(run.encode(), start)
    return run if h % one_in else run[:h % len(run)] + run[h % len(run) + 1:]


def _counted(least: int, one_in: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                              names=["word", "n"])
            total.clear()
            return done

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, n in runs(text.as_buffer().to_pybytes().translate(_LOWER).decode(), least).items():
                    word = misspell(run, start, one_in)
                    if len(word) >= least:
                        total[word] += n
                if len(total) > HELD:
                    yield out()
        if total:
            yield out()
    return counted


# ------------------------------------------------------------------ the index

class Index:
    """Bitsets over some words, given in the order of preference: bit i stands for ``words[i]``."""

    def __init__(self, words: list[str]):
        self.at: dict[tuple[int, str], int] = {}
        self.of_size: dict[int, int] = {}
        for i, word in enumerate(words):
            bit = 1 << i
            self.of_size[len(word)] = self.of_size.get(len(word), 0) | bit
            for place in enumerate(word):
                self.at[place] = self.at.get(place, 0) | bit
        self.all = (1 << len(words)) - 1

    def near(self, word: str, sizes: tuple[int, ...], unless_prefix: int = 0) -> int:
        """Bitset of the words with one of ``sizes`` letters that differ from ``word`` in exactly one
        inserted, deleted or replaced letter; without those that share its first ``unless_prefix`` letters."""
        at = self.at.get
        exact, replaced, extra, missing, shared = self.all, 0, 0, 0, 0
        before, here = 0, at((0, word[0]), 0)
        for i, letter in enumerate(word):
            after = at((i + 1, letter), 0)
            missing = missing & before | exact
            extra = (extra | exact) & after
            replaced = replaced & here | exact & ~here
            exact &= here
            if i + 1 == unless_prefix:
                shared = exact
            if i + 1 < len(word):
                letter = word[i + 1]
                before, here = at((i, letter), 0), at((i + 1, letter), 0)
        n, size = len(word), self.of_size.get
        found = 0
        if n in sizes:
            found |= replaced & size(n, 0)
        if n + 1 in sizes:
            found |= (extra | exact) & size(n + 1, 0)
        if n - 1 in sizes:
            found |= missing & size(n - 1, 0)
        return found & ~shared


def _bucketed(vocabulary: DataFrame) -> DataFrame:
    """(short, half, part, word, n): the buckets of each word.

    Two near words whose shorter has m letters share their first m // 2 or their last m - m // 2 letters, as the one
    error lies behind the former or before the latter. A word is the shorter one (short = its size), or the longer (its size - 1)."""
    m = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("short")
    k = F.floor(F.col("short") / 2).cast("int")
    halves = F.array(F.struct(F.lit("first").alias("half"), F.expr("substring(word, 1, short div 2)").alias("part")),
                     F.struct(F.lit("last").alias("half"), F.expr("substring(word, length(word) - (short - short div 2) + 1)").alias("part")))
    return (vocabulary.select("word", "n", m).where(k > 0).withColumn("h", F.explode(halves))
            .select("short", "h.half", "h.part", "word", "n"))


_GROUP = ["short", "half", "part", "i", "j"]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a group that asks: how many words of the group's index are near, and the
    most frequent of them. Words that share the first half meet in that bucket only."""
    for t, edge in whole_groups(batches, _GROUP):
        short, half = t.column("short").to_pylist(), t.column("half").to_pylist()
        word, n = t.column("word").to_pylist(), t.column("n").to_pylist()
        indexed, asks = t.column("indexed").to_pylist(), t.column("asks").to_pylist()
        out: list[tuple] = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo < 2:
                continue
            held = sorted((x for x in range(lo, hi) if indexed[x]), key=lambda x: (-n[x], word[x]))
            m, prefix = short[lo], short[lo] // 2 if half[lo] == "last" else 0
            index = Index([word[x] for x in held])
            for x in range(lo, hi):
                if asks[x]:
                    found = index.near(word[x], (m, m + 1) if len(word[x]) == m else (m,), prefix)
                    if found:
                        best = held[(found & -found).bit_length() - 1]
                        out.append((word[x], found.bit_count(), n[best], word[best]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                             names=["word", "n_near", "best_n", "best"])


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) for the words of ``vocabulary`` (word, n; distinct words, staged) that have near words.

    Buckets of more than ``block`` words are cut into blocks by hash; every pair of blocks is a group, so no
    group holds more than about two blocks. A group gives one row per word, not one per pair."""
    dealt = _bucketed(vocabulary)
    bucket = ["short", "half", "part"]
    sizes = stage(dealt.groupBy(*bucket).agg(F.count(F.lit(1)).alias("members")), "buckets")
    large = stage(sizes.where(F.col("members") > block), "large")
    rest = sizes.where((F.col("members") > 1) & (F.col("members") <= block))
    whole = dealt.join(rest.drop("members"), bucket, "left_semi").select(
        *bucket, F.lit(0).alias("i"), F.lit(0).alias("j"), "word", "n", F.lit(True).alias("indexed"), F.lit(True).alias("asks"))
    # i: the block that is indexed, j: the one that asks
    cut = (dealt.join(large, bucket).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
           .withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    cut = cut.select(*bucket, "own", "other", "word", "n")
    side = lambda i, j, indexed, asks: cut.where(F.lit(True) if indexed != asks else F.col("own") == F.col("other")).select(
        *bucket, F.col(i).alias("i"), F.col(j).alias("j"), "word", "n", F.lit(indexed).alias("indexed"), F.lit(asks).alias("asks"))
    several = (side("own", "other", True, False).where("i <> j").unionByName(side("other", "own", False, True).where("i <> j"))
               .unionByName(side("own", "own", True, True)))
    groups = whole if large.isEmpty() else whole.unionByName(several)
    parts = shuffle_partitions(vocabulary.sparkSession)
    found = (groups.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP)
             .mapInArrow(_asked, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


# ------------------------------------------------------------------ forms and roots

def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), staged: the end of the path of forms. Each round doubles the steps that are
    known; words that many point to are joined apart."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        pointed = now.groupBy("root").agg(F.count(F.lit(1)).alias("times"))
        further = stage(now.select(F.col("word").alias("root"), F.col("root").alias("next")).join(pointed, "root"), "further")
        if further.isEmpty():
            return now
        now = stage(join_by_count(now, further, "root", "times").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5,
                      least_count: int = 3, ratio: int = 2, one_in: int = 97, block: int = BLOCK) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are the runs of letters of all texts, after a slip in one of ``one_in`` (document, run) pairs
    (``misspell``), of ``least_letters`` characters and ``least_count`` occurrences or more. ``form`` is the
    most frequent near word (ties: the smallest by code points) if it occurs at least ``ratio``
    times as often (2 or more, so that forms never lead back); ``root`` the last of the forms from the word on, or the word itself.

    A null text has no words; a null id is hashed as an empty one. Repeated rows count
    as often as they occur. An empty table gives no rows. Other columns are not read."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    vocabulary = stage(source.mapInArrow(_counted(least_letters, one_in), "word string, n long")
                       .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "vocabulary")
    near = near_words(vocabulary, block)
    takes = F.col("best_n") >= ratio * F.col("n")
    found = stage(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best")).alias("form"),
        F.when(takes, F.col("best_n")).alias("form_n")), "variants")
    ends = roots(spark, stage(found.where(F.col("form").isNotNull()).select("word", "form"), "forms"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
