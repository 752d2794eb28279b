"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``HASHES`` minima of ``BITS`` bits. It is split into ``CHUNKS`` chunks;
two signatures that differ in at most 2 * CHUNKS - 1 places have, by pigeonhole, a chunk
with one difference at most. So every chunk is indexed once for each of its places, left
out: all pairs within that distance meet under some key. Links are confirmed on the full
shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BETWEEN_SPACES, drop_ids, join_by_count, mix, runs_hash, stage, text_slices, words
from .components import components

HASHES, BITS, CHUNKS = 64, 16, 12
#: Signatures within this distance are certain to meet under a key.
DISTANCE = 2 * CHUNKS - 1
#: Pairs that meet are confirmed on their sets unless they are further apart than this: at
#: similarity 0.8 a distance of 13 is expected, 30 is more than five deviations off.
NOT_BEYOND = 30
#: Sets smaller than this are similar by 0.8 only when equal.
SMALLEST = 4
#: Rounds with hubs go on while this share of their pairs turns out to be linked.
WORTH = 0.1
#: Classes of one key that are compared in one group; more are split into blocks.
BLOCK = 1024
#: Rows with whole sets count as so many slim ones when tasks are dealt.
_WIDE = 16

_draw = np.random.default_rng(77)
_TIMES = (_draw.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_PLUS = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ONE = np.uint64(0xD6E8FEB86659FD93)


# ------------------------------------------------------------------ sets and signatures

def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and the size
    of each set. A shingle is ``width`` words (lower-cased A-Z, split at white space); a
    text of fewer words is one shingle, one without words has none."""
    w = words(texts, BETWEEN_SPACES)
    runs = runs_hash(w.hash, width)
    sets, sizes = [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        if hi - lo >= width:
            own = np.sort(runs[lo:hi - width + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif hi > lo:
            own = runs_hash(w.hash[lo:hi], hi - lo) ^ np.uint64(hi - lo)
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def _signed(width: int):
    """Row id, doc id, set size, 16-byte key of the set, signature. The key is two sums of
    independently mixed shingle hashes: equal sets have equal keys."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "text"):
            flat, sizes = shingle_sets(piece.column(1), width)
            full = np.flatnonzero(sizes)
            first = (np.cumsum(sizes) - sizes)[full]
            key = np.zeros((len(sizes), 2), np.uint64)
            sig = np.zeros((len(sizes), HASHES), np.uint16)
            if len(full):
                key[full, 0] = np.add.reduceat(mix(flat * _ONE), first)
                key[full, 1] = np.add.reduceat(mix(flat ^ _ONE), first)
                short = (flat >> np.uint64(32)).astype(np.uint32)
                for j in range(HASHES):
                    sig[full, j] = np.minimum.reduceat(short * _TIMES[j] + _PLUS[j], first).astype(np.uint16)
            keys, sigs = key.tobytes(), sig.tobytes()
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(sizes),
                 pa.array([keys[16 * i:16 * i + 16] for i in range(len(sizes))], pa.binary()),
                 pa.array([sigs[2 * HASHES * i:2 * HASHES * (i + 1)] for i in range(len(sizes))], pa.binary())],
                names=["id", "n_shingles", "set_key", "sig"])
    return signed


def _chunk_places() -> list[tuple[int, np.ndarray]]:
    """(chunk and left-out place as a number, places that make the key), one per key of a signature."""
    keys = []
    for chunk in np.array_split(np.arange(HASHES), CHUNKS):
        for out in chunk:
            keys.append((int(out), chunk[chunk != out]))
    return keys


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each signature: 64-bit hashes of a chunk without one of its places."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, HASHES).astype(np.uint64)
        out = np.zeros((n, HASHES), np.uint64)
        for left_out, places in _chunk_places():
            h = np.full(n, np.uint64(left_out + 1))
            for p in places:
                h = h * np.uint64(0x9E3779B97F4A7C15) + sig[:, p] + np.uint64(1)
            out[:, left_out] = mix(h)
        yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)),
                                          pa.array(np.repeat(batch.column(0).to_numpy(), HASHES)),
                                          pa.array(np.tile(np.arange(HASHES, dtype=np.int32), n))], names=["key", "cid", "place"])


def _sets(width: int):
    """Key and whole set of each text."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "text"):
            flat, sizes = shingle_sets(piece.column(0), width)
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            key = [np.array([mix(p * _ONE).sum(dtype=np.uint64), mix(p ^ _ONE).sum(dtype=np.uint64)]).tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array([p.tobytes() for p in parts], pa.binary())],
                                             names=["set_key", "shingles"])
    return sets


def _linked(percent: int):
    """Keeps the pairs whose sets are similar: 100 * intersection >= percent * union."""
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return linked


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose signatures are not beyond ``NOT_BEYOND``."""
    for batch in batches:
        n = batch.num_rows
        if n:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, HASHES) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x != y).sum(axis=1) <= NOT_BEYOND))


_CHUNK_START = np.array([c[0] for c in np.array_split(np.arange(HASHES), CHUNKS)])


def _first_place(differ: np.ndarray) -> np.ndarray:
    """The first key that each pair shares, by the place it leaves out (``differ``: pairs x places;
    HASHES if they share none): of the first chunk with one difference at most, that place."""
    errors = np.add.reduceat(differ, _CHUNK_START, axis=1)
    meets = errors <= 1
    chunk = meets.argmax(axis=1)
    row = np.arange(len(differ))
    start = _CHUNK_START[chunk]
    width = int(np.diff(np.append(_CHUNK_START, HASHES)).max())
    inside = differ[row[:, None], np.minimum(start[:, None] + np.arange(width), HASHES - 1)]
    place = np.where(errors[row, chunk] == 0, start, start + inside.argmax(axis=1))
    return np.where(meets.any(axis=1), place, HASHES)


_PART = ("key", "i", "j", "place", "cid", "size", "root", "block")
_PART_SQL = "key long, i int, j int, place int, cid long, size long, root long, block int"


def _near_in_group(g: dict, sig: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a group (two blocks of a key, or one with itself) and the rows each is near: of
    another component, of similar size, not beyond ``NOT_BEYOND``, under the first key they share."""
    i, j, here = g["i"][0], g["j"][0], g["place"][0]
    cid, size, root = g["cid"], g["size"], g["root"]
    right = np.flatnonzero(g["block"] == j)
    for x in np.flatnonzero(g["block"] == i):
        other = right[cid[right] > cid[x]] if i == j else right
        other = other[(root[other] != root[x]) & (size[other] * 100 >= size[x] * percent) & (size[x] * 100 >= size[other] * percent)]
        if len(other):
            differ = sig[other] != sig[x]
            near = differ.sum(axis=1) <= NOT_BEYOND
            if near.any():
                other = other[near][_first_place(differ[near]) == here]
                if len(other):
                    yield x, other


def _by_group(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
    """``use(g, sig, table)`` of every group, from rows sorted by (key, i, j); a group that goes
    on in the next batch waits for it."""
    held: pa.Table | None = None
    for batch in _with_end(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
        elif held is None:
            return
        t = held.combine_chunks()
        g = {c: t.column(c).to_numpy() for c in _PART}
        turns = (np.diff(g["key"]) != 0) | (np.diff(g["i"]) != 0) | (np.diff(g["j"]) != 0)
        edge = np.concatenate([[0], np.flatnonzero(turns) + 1, [len(g["key"])]])
        whole = edge if batch is None else edge[:-1]
        if len(whole) > 1:
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            for lo, hi in zip(whole[:-1], whole[1:]):
                yield from use({c: v[lo:hi] for c, v in g.items()}, sig[lo:hi], t.slice(lo, hi - lo))
        held = t.slice(whole[-1]) if whole[-1] < t.num_rows else None


def _taking_part(percent: int):
    """The rows of each group that are near another one."""
    def use(g: dict, sig: np.ndarray, t: pa.Table) -> Iterator[pa.RecordBatch]:
        used = np.zeros(len(sig), bool)
        for x, other in _near_in_group(g, sig, percent):
            used[x] = used[other] = True
        if used.any():
            yield from t.select(list(_PART)).filter(pa.array(used)).to_batches()

    return lambda batches: _by_group(batches, use)


def _linked_in_groups(percent: int):
    """The links between rows of each group: what is near, confirmed on the full sets."""
    def use(g: dict, sig: np.ndarray, t: pa.Table) -> Iterator[pa.RecordBatch]:
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("shingles")]
        a, b = [], []
        for x, others in _near_in_group(g, sig, percent):
            for y in others:
                at = np.searchsorted(sets[y], sets[x])
                same = int((sets[y][np.minimum(at, len(sets[y]) - 1)] == sets[x]).sum())
                if 100 * same >= percent * (len(sets[x]) + len(sets[y]) - same):
                    a.append(max(g["cid"][x], g["cid"][y]))
                    b.append(min(g["cid"][x], g["cid"][y]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lambda batches: _by_group(batches, use)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None after the last."""
    yield from batches
    yield None


# ------------------------------------------------------------------ links

def _sets_of(cids: DataFrame, classes: DataFrame, source: DataFrame, width: int, n: int) -> DataFrame:
    """(cid, shingles) of some classes (``n`` at most), from their texts, staged."""
    named = stage(cids.join(classes.select("cid", "min_id", "set_key"), "cid"), "named", n)
    ids = named.select("min_id").distinct()
    few = named.count() <= common.BROADCAST_IDS
    if few:
        ids = F.broadcast(ids)
    texts = source.join(ids, F.col("id").eqNullSafe(F.col("min_id")), "left_semi").select("text")
    names = named.select("set_key", "cid")
    # a set may come from several rows of one id, or copies of one text: any of them will do
    sets = texts.mapInArrow(_sets(width), "set_key binary, shingles binary").join(F.broadcast(names) if few else names, "set_key")
    return stage(sets.dropDuplicates(["cid"]).select("cid", "shingles"), "sets", _WIDE * n)


def _confirm(pairs: DataFrame, classes: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar. ``pairs`` is staged."""
    n = pairs.count()
    sized = classes.select("cid", "n_shingles", "sig")
    a = sized.select(F.col("cid").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    b = sized.select(F.col("cid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    close = (pairs.join(a, "a").join(b, "b")
             .where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
             .select("a", "b", "sa", "sb").mapInArrow(_near, "a long, b long"))
    close = stage(close, "close", n)
    both = close.select(F.col("a").alias("cid")).unionByName(close.select(F.col("b").alias("cid"))).distinct()
    sets = _sets_of(both, classes, source, width, 2 * n)
    met = (close.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
           .join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b"))
    return met.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long")


def _components_of(shared: DataFrame, classes: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) of the classes that are linked, from ``shared`` (key, cid, size: keys that
    several classes have).

    In rounds, every key with classes of several components gets a hub, one of its classes by
    hash, another one each round, and every class of another component is compared with it:
    one pair per entry of the index at most. What is linked becomes one component. When a
    round links few of its pairs, the classes of different components that still share a key
    are compared with each other by their signatures, in blocks of ``BLOCK``, and what is near
    is confirmed there, so that no link is lost. Only links leave a block."""
    spark = shared.sparkSession
    n = shared.count()
    none = spark.range(0)
    found = none.select(F.col("id").alias("node"), F.col("id").alias("root"))
    tested = none.select(F.col("id").alias("a"), F.col("id").alias("b"))
    fits = (F.col("size") * 100 >= F.col("other_size") * percent) & (F.col("other_size") * 100 >= F.col("size") * percent)
    turn, last = 0, False
    while True:
        root = F.col("cid") if turn == 0 else F.coalesce("root", "cid")
        placed = shared if turn == 0 else shared.join(found, F.col("cid") == F.col("node"), "left")
        placed = placed.select("key", "place", "cid", "size", root.alias("root"))
        if turn:  # from now on only keys with several components
            several = (placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
                       .groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("members")).where("roots > 1"))
            placed = stage(placed.join(several.select("key", "members"), "key"), "placed", n)
            shared, n = placed.drop("root", "members"), placed.count()
            if not n:
                break
        if last:
            blocks = F.ceil(F.col("members") / BLOCK).cast("int")
            dealt = (placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
                     .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                     .withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
                     .join(classes.select("cid", "sig"), "cid")
                     .select(*_PART, "sig"))
            part = stage(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                         .mapInArrow(_taking_part(percent), _PART_SQL), "part", n)
            sets = _sets_of(part.select("cid").distinct(), classes, source, width, part.count())
            late = (part.join(classes.select("cid", "sig"), "cid").join(sets, "cid").repartition("key", "i", "j")
                    .sortWithinPartitions("key", "i", "j").mapInArrow(_linked_in_groups(percent), "a long, b long"))
            links = stage(late, "links")
            if not links.isEmpty():
                stars = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
                found = stage(components(stage(links.unionByName(stars), "links", n)), "components", n)
            break
        chance = F.xxhash64("cid", F.when(F.lit(turn > 0), F.col("key")), F.lit(turn))
        hubs = placed.groupBy("key").agg(F.min(F.struct(chance.alias("h"), F.col("cid").alias("other"), F.col("size").alias("other_size"),
                                                        F.col("root").alias("other_root"))).alias("hub"))
        hubs = stage(hubs.select("key", "hub.other", "hub.other_size", "hub.other_root"), "hubs", n)
        pairs = (placed.join(hubs, "key").where((F.col("root") != F.col("other_root")) & fits)
                 .select(F.greatest("cid", "other").alias("a"), F.least("cid", "other").alias("b")))
        pairs = stage(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs", n)
        n_pairs = pairs.count()
        links = stage(_confirm(pairs, classes, source, width, percent), "links", _WIDE * n_pairs)
        n_links = links.count()
        if n_links:
            stars = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
            found = stage(components(stage(links.unionByName(stars), "links", n)), "components", n)
        last = n_links < WORTH * max(n_pairs, 1)
        tested = tested.unionByName(pairs)
        turn += 1
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``n_shingles``, ``component_id``, ``kept``, ``class_id``.

    Two rows are linked when their sets of ``width``-word shingles have 100 * intersection >=
    ``percent`` * union (``percent`` is 80 or more: the index is laid out for it). Rows with
    equal sets are a class; ``class_id`` is its smallest id. ``component_id`` is the smallest id that can be
    reached over links, ``kept`` says that it is the row's own.

    Null, empty and blank texts have an empty set and are linked with nothing: each is its
    own component and kept. A null id is larger than any other; it is the component's id only
    if there is no other. Repeated rows are one class and have equal results. No rows give no
    rows. Other columns are not read.

    Copies meet as one class, so a group of any size is one entry of the index. Under a key,
    classes are compared with a hub, not with each other, as long as that links any."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(source.mapInArrow(_signed(width), "id long, n_shingles long, set_key binary, sig binary")
                 .withColumn("row_id", F.monotonically_increasing_id()), "signatures")
    n_rows = rows.count()
    classes = stage(rows.where("n_shingles > 0").groupBy("set_key", "n_shingles")
                    .agg(F.min("row_id").alias("cid"), F.min("id").alias("min_id"), F.count(F.lit(1)).alias("n_rows"),
                         F.min("sig").alias("sig")), "classes", n_rows)
    keys = stage(classes.where(F.col("n_shingles") >= SMALLEST).select("cid", "sig")
                 .mapInArrow(_keys, "key long, cid long, place int"), "keys")
    n_keys = keys.count()
    often = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("often", F.lit(True)), "often", n_keys)
    sized = classes.select("cid", F.col("n_shingles").alias("size"))
    shared = join_by_count(keys, often, "key", "n").where("often").drop("often")
    shared = stage(shared.join(sized, "cid"), "shared", n_keys)
    found = _components_of(shared, classes, source, width, percent)

    # classes to components, rows to classes
    root = stage(found.join(classes.select(F.col("cid").alias("node"), "min_id"), "node")
                 .groupBy("root").agg(F.min("min_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "roots", n_rows)
    of_class = join_by_count(found, root, "root", "n").select(F.col("node").alias("cid"), "component_id")
    classes = stage(classes.join(of_class, "cid", "left")
                    .select("set_key", F.col("min_id").alias("class_id"), F.coalesce("component_id", "min_id").alias("component_id"),
                            "n_rows"), "classes", n_rows)
    full = join_by_count(rows.where("n_shingles > 0").select("id", "n_shingles", "set_key"), classes, "set_key", "n_rows")
    empty = rows.where("n_shingles = 0").select("id", "n_shingles", "set_key", F.col("id").alias("class_id"),
                                                F.col("id").alias("component_id"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), "n_shingles", "component_id",
                                          F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2,
                         percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest id; all columns.

    Ids are taken to identify rows; of rows that repeat an id and text one stays. Rows
    without an id stay, as they cannot be told apart."""
    found = stage(near_duplicates(docs, id_col, text_col, width, percent).where(F.col(id_col).isNotNull()), "groups")
    lost = stage(found.where("not kept").select(F.col(id_col).alias("__lost")).distinct(), "lost")
    again = stage(found.where("kept").groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
                  .select(F.col(id_col).alias("__again")), "again")
    kept = drop_ids(docs, lost, id_col)
    if again.isEmpty():
        return kept
    several = kept.join(again, F.col(id_col) == F.col("__again"), "left_semi").dropDuplicates([id_col, text_col])
    return drop_ids(kept, again, id_col).unionByName(several)
