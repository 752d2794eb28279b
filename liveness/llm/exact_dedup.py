"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Senders (blocks of rows of one task) send each owner of a fingerprint range their sorted
distinct fingerprints, gap-coded; owners answer with one bit per fingerprint: is it in
another block too? Only rows with a set bit, or with a copy in their own block, are
suspects, and only their texts are shuffled and compared byte by byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import drop_ids, join_by_count, shuffle_partitions, stage

#: Rows of a block at most: what a sender holds at once (about 60 bytes a row).
BLOCK_ROWS = 1 << 18
#: Bits of a fingerprint. Of N different texts about N / 2^48 of each are suspected without need.
FINGERPRINT_BITS = 48

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------------ Golomb-Rice coding

def encode(values: np.ndarray, low: int) -> tuple[int, bytes]:
    """Sorted distinct integers, all at least ``low``, as Rice-coded gaps: the parameter
    k and the code, first all quotients in unary, then all k-bit remainders."""
    gaps = np.diff(values, prepend=np.uint64(low)).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, float(gaps.mean())) * 0.69)) + 1)
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8)).tobytes()


def decode(code: bytes, n: int, k: int, low: int) -> np.ndarray:
    """The ``n`` integers that ``encode`` coded with parameter ``k``."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    tail = -(-n * k // 8) * 8  # the remainders fill whole bytes at the end
    ones = np.flatnonzero(bits[:len(bits) - tail])[:n]
    q = np.diff(ones, prepend=-1) - 1
    rest = bits[len(bits) - tail:][:n * k].reshape(n, k).astype(np.uint64)
    r = (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((q.astype(np.uint64) << np.uint64(k)) + r) + np.uint64(low)


def _lowest(owner: int, owners: int) -> int:
    """The smallest fingerprint of an owner's range."""
    return -(-(owner << FINGERPRINT_BITS) // owners)


#: Fingerprints that an owner holds at once, about (8 bytes each, and a few arrays of them).
OWNER_ROWS = 1 << 22

# ------------------------------------------------------------------ the three sides of the exchange

_SENT = pa.schema([("row_id", pa.int64()), ("id", pa.int64()), ("digest", pa.binary()), ("block", pa.int64()),
                   ("owner", pa.int32()), ("ord", pa.int32()), ("twice", pa.bool_()),
                   ("k", pa.int32()), ("code", pa.binary())])


def _send(owners: int):
    """Map side: rows with their place in the block's sorted fingerprints, and the coded
    fingerprints themselves (rows with a ``code``)."""
    def block_out(block: int, ids: list, digests: list) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        fp = np.zeros(len(raw), np.uint64)
        for i in range(FINGERPRINT_BITS // 8):
            fp = (fp << np.uint64(8)) | raw[:, i].astype(np.uint64)
        distinct, place, copies = np.unique(fp, return_inverse=True, return_counts=True)
        lows = np.array([_lowest(o, owners) for o in range(owners)], np.uint64)
        owner = np.searchsorted(lows, distinct, side="right") - 1
        first = np.searchsorted(owner, np.arange(owners + 1))
        n = len(fp)
        nothing = lambda kind, m: pa.nulls(m, kind)
        at = owner[place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block * BLOCK_ROWS + np.arange(n)), pa.array(ids, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(np.full(n, block)), pa.array(at.astype(np.int32)), pa.array((place - first[at]).astype(np.int32)),
             pa.array(copies[place] > 1), nothing(pa.int32(), n), nothing(pa.binary(), n)], schema=_SENT)
        used = np.flatnonzero(np.diff(first))
        codes = [encode(distinct[first[o]:first[o + 1]], int(lows[o])) for o in used]
        m = len(used)
        yield pa.RecordBatch.from_arrays(
            [nothing(pa.int64(), m), nothing(pa.int64(), m), nothing(pa.binary(), m), pa.array(np.full(m, block)),
             pa.array(used.astype(np.int32)), pa.array(np.diff(first)[used].astype(np.int32)), nothing(pa.bool_(), m),
             pa.array([k for k, _ in codes], pa.int32()), pa.array([c for _, c in codes], pa.binary())], schema=_SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids: list = []
        digests: list = []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                digests.append(hashlib.sha256((text.as_buffer().to_pybytes() if text.is_valid else b"").lower()).digest())
                if len(ids) == BLOCK_ROWS:
                    yield from block_out(block, ids, digests)
                    block, ids, digests = block + 1, [], []
        if ids:
            yield from block_out(block, ids, digests)
    return send


def _answer(owners: int):
    """Owner side: for each block one bit per fingerprint, set when another block has it."""
    def answer(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        low = _lowest(owner, owners)
        counts = table.column("ord").to_pylist()
        got = [decode(c, n, k, low) for c, n, k in
               zip(table.column("code").to_pylist(), counts, table.column("k").to_pylist())]
        _, place, times = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
        shared = np.split(times[place] > 1, np.cumsum(counts)[:-1])
        return pa.table({"block": table.column("block"), "owner": table.column("owner"),
                         "bits": pa.array([np.packbits(s, bitorder="little").tobytes() for s in shared], pa.binary())})
    return answer


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     owners: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
    largest id stays. A null text is empty. A null id counts as smaller than any other; of
    rows that repeat an id and text exactly one stays. An empty table gives no rows. Other
    columns, whatever their names, are not read.

    ``owners``: fingerprint ranges, by default one for each ``OWNER_ROWS`` rows, and as many as shuffle
    partitions at least; so what one of them holds at once does not grow with the table. However often one text
    is copied, a sender sends its fingerprint once. The only step that
    moves texts is the verification, after a partial aggregation that leaves one copy of a
    text per task."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    owners = owners or max(shuffle_partitions(spark), -(-source.count() // OWNER_ROWS))
    schema = "row_id long, id long, digest binary, block long, owner int, ord int, twice boolean, k int, code binary"
    binary = source.select("id", F.col("text").cast("binary").alias("text"))
    sent = stage(binary.mapInArrow(_send(owners), schema), "fingerprints")

    codes = sent.where(F.col("code").isNotNull()).select("block", "owner", "ord", "k", "code")
    answers = codes.groupBy("owner").applyInArrow(_answer(owners), "block long, owner int, bits binary")
    bit = F.expr("shiftright(cast(conv(hex(substring(bits, ord div 8 + 1, 1)), 16, 10) as int), ord % 8) & 1") == 1
    rows = sent.where(F.col("code").isNull()).select("row_id", "id", "digest", "block", "owner", "ord", "twice")
    rows = stage(rows.join(answers, ["block", "owner"])
                 .select("row_id", "id", "digest", (F.col("twice") | bit).alias("suspect")), "suspects", sent.count())
    suspects = rows.where("suspect")

    # byte verification: the texts of suspects only, grouped by their bytes
    ids = suspects.select("id").distinct().withColumnRenamed("id", "sid")
    if suspects.count() <= common.BROADCAST_IDS:
        ids = F.broadcast(ids)
    equal = (source.join(ids, F.col("id").eqNullSafe(F.col("sid")), "left_semi")
             .groupBy(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("norm"))
             .agg(F.count(F.lit(1)).alias("n"))
             .select(F.unhex(F.sha2("norm", 256)).alias("digest"), "n"))
    # an id may repeat with another text that is no suspect; the digests of suspects leave it out
    winners = suspects.groupBy("digest").agg(F.max(F.struct("id", "row_id")).alias("w"))
    groups = stage(equal.join(winners, "digest")
                   .select("digest", F.col("w.id").alias("keep_id"), F.col("w.row_id").alias("keep_row"), "n",
                           F.col("n").alias("group_size")), "groups")
    met = join_by_count(suspects.select("row_id", "id", "digest"), groups, "digest", "n")
    alone = rows.where(~F.col("suspect")).select(
        "row_id", "id", "digest", F.col("id").alias("keep_id"), F.col("row_id").alias("keep_row"),
        F.lit(1).cast("long").alias("group_size"))
    return met.unionByName(alone).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, all columns.

    Ids are taken to identify rows; of rows that repeat an id and text one stays. Rows
    without an id stay, as they cannot be told apart."""
    found = stage(exact_duplicates(docs, id_col, text_col).where(F.col(id_col).isNotNull()), "kept")
    lost = stage(found.where("not kept").select(F.col(id_col).alias("__lost")).distinct(), "lost")
    again = stage(found.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
                  .select(F.col(id_col).alias("__again")), "again")
    single = drop_ids(docs, lost, id_col)
    if again.isEmpty():
        return single
    # ids on several rows: by id and text
    kept = found.where("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    norm = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), 256)
    several = (docs.join(again, F.col(id_col) == F.col("__again"), "left_semi").withColumn("__text_sha", norm)
               .join(kept, (F.col(id_col) == F.col("__id")) & (F.col("__text_sha") == F.col("__sha")), "left_semi")
               .dropDuplicates([id_col, "__text_sha"]).drop("__text_sha"))
    return drop_ids(single, again, id_col).unionByName(several)
