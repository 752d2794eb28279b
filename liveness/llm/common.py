"""Shared helpers of the training-data operators: staging, skew-proof joins and a
vectorised tokenizer that works on whole Arrow batches."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, stage_root

#: Text bytes handled at once inside a task; the numpy work arrays take about 60 times this.
SLICE_BYTES = 1 << 20


# ------------------------------------------------------------------ staging

#: Rows of a slim table (a few numbers and hashes) that one task writes, where their number is known.
ROWS_PER_TASK = 100_000


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back:
    the lineage ends there, and a lost executor costs a reread, not a recomputation.

    ``rows``: a bound of its rows, where known. Few rows are then written by few tasks; a
    large table keeps the partitions it has, as their number is only ever lowered."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    if (own := _staged.get()) is not None:
        own.append(path)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(*frames: DataFrame) -> None:
    """Delete the folders of staged tables that are no longer needed."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(df.sparkSession, folder)


_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that ``stage`` writes inside the block are deleted at its end: for jobs that have written
    their results by then. What other queries of the session have staged stays."""
    own: list[str] = []
    token = _staged.set(own)
    try:
        yield
    finally:
        _staged.reset(token)
        for path in own:
            delete_path(spark, path)


class Shared:
    """A value that every task needs, broadcast as bytes that bring their classes along: executors
    need no copy of the package, which a plain broadcast of an object of it would ask for."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self):
        return {"_sent": self._sent}

    @property
    def value(self):
        if "_value" not in self.__dict__:
            self._value = pickle.loads(self._sent.value)
        return self._value


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ joins

def join_by_count(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """Left join of ``left`` with ``right`` (one row per key; ``n``: how many left rows
    have it) that no hot key can put into one task.

    At most P keys can each hold more than 1/P of the rows, so with P the number of
    shuffle partitions the table of hot keys has at most P rows and may be broadcast.
    All other keys are joined by shuffle. ``n`` is dropped. Rows with a null key stay,
    with nulls. Both sides are read twice: hand in staged tables."""
    parts = shuffle_partitions(left.sparkSession)
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = right.where(F.col(n) * parts > F.lit(total))
    cold = right.where(F.col(n) * parts <= F.lit(total)).drop(n)
    met = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True)).drop(n)), key, "left")
    values = [c for c in right.columns if c not in (key, n)]
    rest = met.where(F.col("__hot").isNull()).select(*left.columns)
    return (met.where(F.col("__hot").isNotNull()).select(*left.columns, *values)
            .unionByName(rest.join(cold, key, "left").select(*left.columns, *values)))


#: Ids that may be broadcast (about 16 bytes each); beyond, rows are picked by a shuffle join.
BROADCAST_IDS = 1 << 19


def bounded(ids: DataFrame, limit: int | None = None) -> DataFrame:
    """``ids`` (a staged table of ids), to be broadcast if it has few rows, else as it is."""
    return F.broadcast(ids) if ids.count() <= (BROADCAST_IDS if limit is None else limit) else ids


def drop_ids(docs: DataFrame, lost: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``lost`` (one column, staged). Rows without an id stay."""
    return docs.join(bounded(lost), F.col(id_col) == F.col(lost.columns[0]), "left_anti")


# ------------------------------------------------------------------ spans

def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each struct(kind, start, end) of an array, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


# ------------------------------------------------------------------ Arrow batches

def text_slices(batches: Iterator[pa.RecordBatch], column: str,
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` text bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = _offsets(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by ``key``: tables that hold every group they touch whole, and the
    offsets where groups begin (and the last ends). A group that goes on in the next batch waits for it."""
    def edges(t: pa.Table) -> np.ndarray:
        turns = np.zeros(max(t.num_rows - 1, 0), bool)
        for c in key:
            v = t.column(c).combine_chunks()
            turns |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(turns) + 1, [t.num_rows]])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = not held or all(held[-1].column(c)[-1] == batch.column(c)[-1] for c in key)
        held.append(batch)
        if same and all(batch.column(c)[0] == batch.column(c)[-1] for c in key):
            continue  # one group so far
        t = pa.Table.from_batches(held)
        edge = edges(t)
        yield t.slice(0, edge[-2]), edge[:-1]
        held = t.slice(edge[-2]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, edges(t)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row (nulls are empty) and the n + 1 offsets into them."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    off = _offsets(texts)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[off[0]:off[-1]], off - off[0]


# ------------------------------------------------------------------ words

def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags: true for bytes inside one of the ranges (ends included)."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return table


#: Bytes of words between white space: all but blank and \\t to \\r. Bytes from 0x80 are
#: parts of other characters, so a byte test is exact in UTF-8.
BETWEEN_SPACES = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words that are runs of digits, letters (after lower-casing) and non-ASCII.
ALPHANUMERIC = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, ``n`` of them at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES), np.uint64(base))
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit moves every output bit (uint64, by multiplication and shifts)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of some texts: 64-bit hash and byte span of each, and where each text's words begin."""
    hash: np.ndarray     # uint64, one per word
    first: np.ndarray    # n + 1 offsets: words of text i are first[i]:first[i + 1]
    start: np.ndarray    # byte offset of each word in ``data``
    end: np.ndarray
    data: np.ndarray     # the (lower-cased) bytes
    text: np.ndarray     # n + 1 byte offsets of the texts

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """Index of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(texts: pa.Array, word_bytes: np.ndarray, lower: bool = True) -> Words:
    """Words of all texts (maximal runs of ``word_bytes``), hashed with 64 bits.

    The hash is a polynomial over the word's bytes modulo 2^64, mixed: equal words have
    equal hashes in any batch and task, and two different words agree with probability 2^-64."""
    data, off = utf8(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(off), np.int64), none, none, data, off)
    inside = word_bytes[data]
    fresh = np.zeros(n + 1, bool)
    fresh[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    if not len(start):
        return Words(np.zeros(0, np.uint64), first, start, end, data, off)
    value = np.where(inside, _BYTE[data], np.uint64(0))
    value *= _power(_P, n)[:n]
    h = mix(np.add.reduceat(value, start) * _power(_P_INVERSE, n)[start])
    return Words(h, first, start, end, data, off)


def runs_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, by the index of its first word
    (runs that go past a text's end are for the caller to leave out)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(_P)
        out += h[j:j + n]
    return mix(out)
