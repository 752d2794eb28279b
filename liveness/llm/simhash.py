"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments. Two fingerprints that differ in at most
``DISTANCE`` bits differ, by pigeonhole, in few bits of some segment. Each segment is a
table; a fingerprint looks up every value of a small Hamming ball around its own, and what
it meets there is verified on all 64 bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BETWEEN_SPACES, join_by_count, shuffle_partitions, stage, text_slices, whole_groups, words
from .components import components

BITS, DISTANCE, SEED = 64, 4, 42
#: Groups of a table up to this size are compared for the whole batch at once.
SMALL_GROUP = 32
#: From this many entries of a group, meeting halfway (2,081 rows for each) costs less than comparing them.
LARGE_GROUP = 1 << 14


# ------------------------------------------------------------------ fingerprints

def fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    """Fingerprint of each text (uint64): a bit is set if more than half of the shingles'
    hashes have it. A shingle is ``width`` words in sequence, repeats included, joined by one
    space; a text of fewer words is one shingle, one without words has fingerprint zero."""
    w = words(texts, BETWEEN_SPACES)
    out = np.zeros(len(texts), np.uint64)
    if not len(w.start):
        return out
    # the words of all texts, one space after each
    size = w.end - w.start
    at = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int(at[-1] + size[-1] + 1), 0x20, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(at, size) + inside] = w.data[np.repeat(w.start, size) + inside]
    count = w.count
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    full = np.flatnonzero(shingles)
    first = (np.cumsum(shingles) - shingles)[full]
    begin = np.arange(int(shingles.sum())) - np.repeat(first, shingles[full]) + np.repeat(w.first[:-1][full], shingles[full])
    last = begin + np.repeat(np.minimum(count[full], width), shingles[full]) - 1
    buffer = joined.tobytes()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(buffer[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[last] + size[last]).tolist())),
                    np.uint64, len(begin))
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > shingles[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprinted(width: int):
    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fingerprints(piece.column(1), width).view(np.int64))],
                                             names=["id", "fp"])
    return fingerprinted


# ------------------------------------------------------------------ the index

def segments(n: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, radius) of each segment for ``n`` fingerprints: as many segments as
    leave each about log2(n) bits, so that a table's entry holds few of them; two at least.

    With distance = q * segments + a, a pair that differs in more than q bits in each of the
    first a + 1 segments and in more than q - 1 in each of the others differs in more than
    ``distance``; so these radii miss no pair."""
    many = max(2, min(distance, BITS // max(1, int(n).bit_length())))
    q, a = divmod(distance, many)
    edge = [BITS * i // many for i in range(many + 1)]
    return [(lo, hi - lo, q if i <= a else q - 1) for i, (lo, hi) in enumerate(zip(edge, edge[1:]))]


def _entries(classes: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """(key, fp, stored): for each segment the values within half its radius, rounded up. Values within half,
    rounded down, are stored in the table; the others only look up. A pair within the radius meets."""
    found = []
    for k, (low, bits, radius) in enumerate(cuts):
        own = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
        for errors in range((radius + 1) // 2 + 1):
            for at in combinations(range(bits), errors):
                value = own.bitwiseXOR(F.lit(sum(1 << b for b in at))) if errors else own
                key = value.bitwiseOR(F.lit(k << 56)) if bits <= 56 else value
                found.append(F.struct(key.alias("key"), F.lit(errors <= radius // 2).alias("stored")))
    return classes.select("fp", F.explode(F.array(*found)).alias("e")).select("e.key", "fp", "e.stored")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of fingerprints that meet in a group and are near on all bits. Small groups give
    each pair with a stored entry; larger ones a forest that spans what is linked in them."""
    for t, edge in whole_groups(batches, ["key"]):
        fp = t.column("fp").to_numpy().view(np.uint64)
        stored = t.column("stored").to_numpy()
        size = np.diff(edge)
        group = np.repeat(np.arange(len(size)), size)
        small = np.flatnonzero((size <= SMALL_GROUP)[group])
        a, b = [], []
        for d in range(1, SMALL_GROUP):
            x, y = small[:-d], small[d:]
            with_ = (group[x] == group[y]) & (stored[x] | stored[y])
            if not (group[x] == group[y]).any():
                break
            x, y = x[with_], y[with_]
            near = np.bitwise_count(fp[x] ^ fp[y]) <= DISTANCE
            a.append(fp[x[near]])
            b.append(fp[y[near]])
        for g in np.flatnonzero(size > SMALL_GROUP):
            for x, y in _forest(np.unique(fp[edge[g]:edge[g + 1]])):
                a.append(x)
                b.append(y)
        if a:
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _forest(left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(newly reached, reached from) of a breadth-first search over distinct fingerprints: one link less
    than members for each component."""
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            here = front.pop()
            near = np.bitwise_count(left ^ here) <= DISTANCE
            if near.any():
                found = left[near]
                left = left[~near]
                front.extend(found)
                yield found, np.full(len(found), here)


def _halfway_masks() -> np.ndarray:
    half = DISTANCE // 2
    return np.array([sum(1 << b for b in at) for e in range(half + 1) for at in combinations(range(BITS), e)], np.uint64)


def _halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every value within half the distance of each fingerprint."""
    masks = _halfway_masks()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            fp = batch.column(0).slice(lo, 256).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ masks).reshape(-1).view(np.int64)),
                                              pa.array(np.repeat(fp, len(masks)).view(np.int64))], names=["middle", "fp"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (middle, fp): each fingerprint linked to the first of its middle."""
    for t, edge in whole_groups(batches, ["middle"]):
        fp = t.column("fp").to_numpy()
        first = np.repeat(fp[edge[:-1]], np.diff(edge))
        pairs = np.unique(np.stack([fp, first], axis=1)[fp != first], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _linked(classes: DataFrame, n: int, large_group: int) -> DataFrame:
    """Links (a, b) between fingerprints, as many as connect all that are linked."""
    entries = _entries(classes, segments(n))
    hot = stage(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("stored").alias("stored"))
                .where((F.col("n") > large_group) & F.col("stored")).select("key"), "hot")
    if hot.isEmpty():
        return (entries.repartition(shuffle_partitions(classes.sparkSession), "key").sortWithinPartitions("key")
                .mapInArrow(_links, "a long, b long"))
    # at most (entries / large_group) keys; their members are compared through the values halfway between two
    inside = stage(entries.join(hot, "key", "left_semi").select("fp").distinct(), "inside")
    cold = entries.join(hot, "key", "left_anti")
    parts = shuffle_partitions(classes.sparkSession)
    met = cold.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
    middles = (inside.mapInArrow(_halfway, "middle long, fp long").repartition(parts, "middle").sortWithinPartitions("middle", "fp")
               .mapInArrow(_stars, "a long, b long"))
    return met.unionByName(middles)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                   large_group: int = LARGE_GROUP) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``fingerprint`` (16 hexadecimal digits), ``component_id``,
    ``class_id``.

    Rows are linked when their fingerprints differ in at most 4 bits. ``class_id`` is the
    smallest id with the same fingerprint, ``component_id`` the smallest that can be reached
    over links, the row's own included. Shingles are counted with repeats; a text without
    words (null, empty, blank) has fingerprint zero, which is linked like any other.

    A null id is larger than any other: it is the id of a class only if there is no other.
    Repeated rows have equal results. An empty table gives no rows. Other columns are not read.

    Copies and all texts of one fingerprint are one entry of the index. A group of the index
    with more than ``large_group`` entries is not compared: each of its members is written
    under all values within 2 bits, where two that are within 4 meet, and linked to the first one there;
    so rows grow in proportion to the members, and no link is lost."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(source.mapInArrow(_fingerprinted(width), "id long, fp long"), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_rows")), "classes")
    links = stage(_linked(classes, classes.count(), large_group).distinct(), "links")
    found = stage(components(links).withColumnRenamed("node", "fp"), "components")
    roots = stage(found.join(classes.select("fp", "class_id"), "fp").groupBy("root")
                  .agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "roots")
    of_class = join_by_count(found, roots, "root", "n").select("fp", "component_id")
    named = stage(classes.join(of_class, "fp", "left")
                  .select("fp", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), "n_rows"), "named")
    return join_by_count(rows, named, "fp", "n_rows").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_id")
