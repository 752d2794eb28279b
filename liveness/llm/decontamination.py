"""Benchmark passages inside documents, by a prefix-filtered set join.

A window of ``width`` item words occurs in a document only if its rarest word does, so of
each window's words, ordered by their count over all documents, one prefix word is enough
to find every candidate. A candidate must fit into the document by position and length,
and is then compared word by word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, Shared, drop_ids, shuffle_partitions, stage, text_slices, words
from .toxicity import Filter

WIDTH = 10
#: Item words whose windows are broadcast together (about 100 bytes a word, so 25 MB). A
#: larger benchmark is joined by shuffle.
BLOCK_WORDS = 1 << 18
#: Candidate (position, window) pairs compared at once inside a task.
CHUNK = 1 << 20
#: Words a task counts before it hands them on, and rows of one batch that it emits.
COUNTED, EMITTED = 1 << 20, 1 << 14


class Windows:
    """Distinct windows of a block of items, looked up by one word of each."""

    def __init__(self, ids: list[str], texts: pa.Array, width: int):
        w = words(texts, ALPHANUMERIC)
        found: dict[bytes, int] = {}
        rows, lengths, pairs = [], [], set()
        for i, name in enumerate(ids):
            h = w.hash[w.first[i]:w.first[i + 1]]
            size = min(width, len(h))
            for at in range(len(h) - size + 1 if size else 0):
                run = h[at:at + size]
                k = found.setdefault(run.tobytes(), len(found))
                if k == len(rows):
                    rows.append(np.pad(run, (0, width - size)))
                    lengths.append(size)
                pairs.add((k, name))
        self.words = np.array(rows, np.uint64).reshape(-1, width)
        self.length = np.array(lengths, np.int64)
        self.inside = np.arange(width) < self.length[:, None]
        self.vocabulary = np.unique(self.words[self.inside])
        held: list[list[str]] = [[] for _ in rows]
        for k, name in pairs:
            held[k].append(name)
        self.items = held

    def choose(self, counts: np.ndarray) -> None:
        """Index the windows by their rarest word; ``counts``: of each vocabulary word."""
        place = np.searchsorted(self.vocabulary, self.words).clip(max=max(len(self.vocabulary) - 1, 0))
        count = np.where(self.inside, counts[place] if len(counts) else 0, np.iinfo(np.int64).max)
        self.offset = count.argmin(axis=1) if len(count) else np.zeros(0, np.int64)
        prefix = self.words[np.arange(len(self.words)), self.offset]
        self.by_prefix = np.argsort(prefix, kind="stable")
        self.prefix, self.begin = np.unique(prefix[self.by_prefix], return_index=True)
        self.begin = np.append(self.begin, len(prefix))


def _table(keys: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << 20, bool)
    flags[(keys >> np.uint64(44)).astype(np.int64)] = True
    return flags


def lookup(keys: np.ndarray, flags: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``h`` of values that are among the sorted ``keys``, and which key each is."""
    at = np.flatnonzero(flags[(h >> np.uint64(44)).astype(np.int64)])
    k = np.searchsorted(keys, h[at]).clip(max=max(len(keys) - 1, 0))
    same = keys[k] == h[at] if len(keys) else np.zeros(0, bool)
    return at[same], k[same]


def _count_words(vocabulary):
    """Map side of the word counts: one row per vocabulary word and task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = vocabulary.value
        flags, total = _table(keys), np.zeros(len(keys), np.int64)
        for piece in text_slices(batches, "text"):
            _, k = lookup(keys, flags, words(piece.column(0), ALPHANUMERIC).hash)
            total += np.bincount(k, minlength=len(keys))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["word", "n"])
    return count


def _matches(w, index: Windows, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in the texts of ``w``."""
    at, k = lookup(index.prefix, flags, w.hash)
    many = index.begin[k + 1] - index.begin[k]
    starts, which = [], []
    reach = np.cumsum(many)
    total = int(reach[-1]) if len(at) else 0
    cuts = np.unique([0, *np.searchsorted(reach, np.arange(CHUNK, total, CHUNK), side="right"), len(at)])
    owner = w.owner[at]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        m = many[lo:hi]
        row = np.repeat(np.arange(lo, hi), m)
        window = index.by_prefix[index.begin[k[row]] + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)]
        start, length = at[row] - index.offset[window], index.length[window]
        fits = (start >= w.first[owner[row]]) & (start + length <= w.first[owner[row] + 1])
        start, window, length = start[fits], window[fits], length[fits]
        for j in range(index.words.shape[1]):
            alive = (j >= length) | (w.hash[np.minimum(start + j, len(w.hash) - 1)] == index.words[window, j])
            start, window, length = start[alive], window[alive], length[alive]
        starts.append(start)
        which.append(window)
    none = np.zeros(0, np.int64)
    return (np.concatenate(starts), np.concatenate(which)) if starts else (none, none)


_FOUND_SQL = "id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _search(index_of):
    """All documents: word count, spans of hit words (word offsets, merged) and items found."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        flags = _table(index.prefix)
        for piece in text_slices(batches, "text"):
            w = words(piece.column(1), ALPHANUMERIC)
            n = piece.num_rows
            starts, ends, items = [[]] * n, [[]] * n, [[]] * n
            start, window = _matches(w, index, flags)
            if len(start):
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + index.length[window], -1)
                hit = np.cumsum(edge[:-1]) > 0
                own = w.owner[start]
                for d in np.unique(own):
                    lo, hi = w.first[d], w.first[d + 1]
                    turn = np.diff(hit[lo:hi].astype(np.int8), prepend=0, append=0)
                    starts[d], ends[d] = np.flatnonzero(turn > 0).tolist(), np.flatnonzero(turn < 0).tolist()
                    items[d] = sorted({name for k in np.unique(window[own == d]) for name in index.items[k]})
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(w.count), pa.array(starts, pa.list_(pa.int64())),
                 pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=["id", "n_words", "starts", "ends", "items"])
    return search


def _found_by_broadcast(source: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """All windows at once in every task."""
    spark = source.sparkSession
    rows = items.toArrow()
    index = Windows(rows.column("item").to_pylist(), rows.column("text").combine_chunks().cast(pa.string()), width)
    counts = np.zeros(len(index.vocabulary), np.int64)
    if len(counts):
        known = spark.sparkContext.broadcast(index.vocabulary)
        for r in (source.select("text").mapInArrow(_count_words(known), "word long, n long")
                  .groupBy("word").agg(F.sum("n").alias("n")).toArrow().to_pylist()):
            counts[r["word"]] = r["n"]
    index.choose(counts)
    return source.mapInArrow(_search(Shared(spark, index)), _FOUND_SQL)


# ------------------------------------------------------------------ benchmarks of any size

def _runs(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Lists of ``length`` values each, from ``start`` on."""
    end = np.cumsum(length)
    at = np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)
    return pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), pa.array(values[at].view(np.int64)))


def _item_windows(width: int):
    """The windows of every item: the hashes of their words, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "text"):
            w = words(piece.column(1), ALPHANUMERIC)
            size = np.minimum(w.count, width)
            many = np.where(size > 0, w.count - size + 1, 0)
            own = np.repeat(np.arange(piece.num_rows), many)
            start = w.first[own] + np.arange(len(own)) - (np.cumsum(many) - many)[own]
            for at in range(0, len(own), EMITTED):
                o = own[at:at + EMITTED]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(o)), _runs(w.hash, start[at:at + EMITTED], size[o])],
                                                 names=["item", "run"])
    return run


def _count_known(known):
    """Map side of the counts of all words that pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for piece in text_slices(batches, "text"):
            h = words(piece.column(0), ALPHANUMERIC).hash
            k, n = np.unique(h[known.value.passes(h)], return_counts=True)
            both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            keys, counts = both, np.bincount(at, np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            if len(keys) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])
    return run


_TOKENS = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()), ("word", pa.int64()),
                     ("at", pa.int64()), ("around", pa.list_(pa.int64()))])
_TOKENS_SQL = "id long, key binary, n_words long, word long, at long, around array<long>"


def _tokens(known, width: int):
    """A row of every document (``word`` null), and one of each word that passes the filter: its offset and the
    ``2 * width - 1`` words around it, 0 outside the text. ``key`` tells texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.arange(1 - width, width)
        for piece in text_slices(batches, "text"):
            w = words(piece.column(1), ALPHANUMERIC)
            keys = pa.array([hashlib.blake2b(t.as_buffer() if t.is_valid else b"", digest_size=16).digest() for t in piece.column(1)],
                            pa.binary())
            none = lambda n, kind: pa.nulls(n, kind)
            n = piece.num_rows
            yield pa.RecordBatch.from_arrays([piece.column(0), keys, pa.array(w.count.astype(np.int64)), none(n, pa.int64()),
                                              none(n, pa.int64()), none(n, _TOKENS.field("around").type)], schema=_TOKENS)
            every, owner = np.flatnonzero(known.value.passes(w.hash)), w.owner
            for lo in range(0, len(every), EMITTED):
                p = every[lo:lo + EMITTED]
                own = owner[p]
                near = p[:, None] + reach
                inside = (near >= w.first[own][:, None]) & (near < w.first[own + 1][:, None])
                around = np.where(inside, w.hash[near.clip(0, len(w.hash) - 1)], np.uint64(0)).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [none(len(p), pa.int64()), keys.take(pa.array(own)), none(len(p), pa.int64()), pa.array(w.hash[p].view(np.int64)),
                     pa.array(p - w.first[own]), _runs(around, np.arange(len(p)) * len(reach), np.full(len(p), len(reach)))],
                    schema=_TOKENS)
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a text, united."""
    for batch in batches:
        starts, ends = [], []
        for spans in batch.column(1).to_pylist():
            merged: list[list[int]] = []
            for lo, hi in sorted((s["start"], s["end"]) for s in spans):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            starts.append([lo for lo, _ in merged])
            ends.append([hi for _, hi in merged])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, kind), pa.array(ends, kind)], names=["key", "starts", "ends"])


def dealt_join(left: DataFrame, right: DataFrame, key: str, deal: Column, how: str = "inner", where: Column | None = None) -> DataFrame:
    """Join on ``key`` that no hot key of ``left`` can put into one task: a key with more than 1/P of its rows
    (there are fewer than P, the shuffle partitions) is dealt by ``deal`` over so many parts that each holds
    1/P at most, and its rows of ``right`` go to every part. ``left`` is read twice: hand in a staged table."""
    parts = shuffle_partitions(left.sparkSession)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = left.count()
    hot = stage(counts.where(F.col("n") * parts > total)
                .select(key, F.ceil(F.col("n") * parts / F.lit(max(total, 1))).cast("int").alias("parts")), "hot-keys", parts)
    over = lambda df: df.join(F.broadcast(hot), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = over(left).withColumn("part", F.pmod(deal, F.col("parts")).cast("int")).drop("parts")
    copied = over(right).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumnsRenamed(
        {key: "__key", "part": "__part"})
    on = (F.col(key) == F.col("__key")) & (F.col("part") == F.col("__part"))
    return dealt.join(copied, on if where is None else on & where, how).drop("part", "__key", "__part")


def _found_by_shuffle(source: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Prefix words are joined by shuffle: documents are read twice at any size of the benchmark, and nothing that
    grows with it is broadcast. A word of a document that may be a prefix is sent with the words around it, so a
    candidate is compared where it is joined."""
    spark = source.sparkSession
    held = stage(items.select("item", "text").mapInArrow(_item_windows(width), "item string, run array<long>").distinct(), "item-windows")
    runs = stage(held.select("run").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    places = stage(runs.select("window", F.posexplode("run").alias("offset", "word")), "window-words")
    vocabulary = stage(places.groupBy("word").agg(F.count(F.lit(1)).alias("held")), "vocabulary")
    counts = (source.select("text").mapInArrow(_count_known(Shared(spark, Filter(vocabulary.withColumnRenamed("word", "feature")))),
                                               "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # the rarest word of a window; a window with a word that no document has occurs nowhere
    prefix = (dealt_join(places, stage(counts, "word-counts"), "word", F.col("window"), "left")
              .groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "word")).alias("p"))
              .where("p.n > 0").select("window", "p.offset", "p.word"))
    prefix = stage(prefix.join(runs, "window").select("word", "offset", "run"), "prefixes")
    known = Shared(spark, Filter(prefix.select(F.col("word").alias("feature")).distinct()))
    rows = stage(source.mapInArrow(_tokens(known, width), _TOKENS_SQL).withColumn("row", F.monotonically_increasing_id()), "tokens")
    tokens = rows.where("word is not null").select("word", "key", "at", "around", "row")
    same = F.slice("around", F.lit(width) - F.col("offset"), F.size("run")) == F.col("run")
    start = F.col("at") - F.col("offset")
    found = stage(dealt_join(tokens, prefix, "word", F.col("row"), where=same)
                  .select("key", start.alias("start"), (start + F.size("run")).alias("end"), "run").distinct(), "found")
    spans = (found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
             .mapInArrow(_merged, "key binary, starts array<long>, ends array<long>"))
    names = (dealt_join(stage(found.select("key", "run").distinct(), "found-windows"), held, "run", F.xxhash64("key"))
             .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    texts = stage(spans.join(names, "key"), "hit-texts")
    docs = rows.where("word is null").select("id", "key", "n_words", "row")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return dealt_join(docs, texts, "key", F.col("row"), "left").select(
        "id", "n_words", none("starts", "array<long>"), none("ends", "array<long>"), none("items", "array<string>"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated``, ``hit_starts`` and ``hit_ends`` (word offsets of the merged hit spans, end exclusive).

    Words are runs of digits, letters and non-ASCII after lower-casing A-Z. A window is
    ``width`` consecutive item words (an item of fewer words, but not none, is one window);
    every document word inside an occurrence of a window is hit. ``items_sha256`` digests
    the ids of the found items, sorted as strings, comma-joined.

    Null or empty text: no words, never hit. A null id stays null. Rows of one item id are
    one item; a null item id is written as an empty string. An empty benchmark hits nothing;
    no documents give no rows. Repeated rows give equal rows. Other columns are not read.

    Each document is read twice where it lies, once to count the benchmark's words over all
    documents, once to search. The windows of a benchmark of ``block_words`` words or fewer are
    broadcast and no document is shuffled. Of a larger one nothing but two filters of 16 MB is broadcast:
    prefix words are joined by shuffle, hot ones in parts; documents are read as often."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    few = size <= 6 * block_words  # words of six characters with their blank
    found = (_found_by_broadcast if few else _found_by_shuffle)(source, items, width)
    hits = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return (found.withColumnsRenamed({"starts": "hit_starts", "ends": "hit_ends"})
            .select(F.col("id").alias(id_col), "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                    (F.size("hit_starts") > 0).alias("contaminated"), "hit_starts", "hit_ends"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark window, all columns. Rows that share an id
    with a contaminated row go too; rows without an id stay."""
    found = stage(contamination(docs, benchmark, id_col, text_col).where("contaminated")
                  .select(F.col(id_col).alias("__leak")).distinct(), "leaks")
    return drop_ids(docs, found, id_col)
