"""Document quality by co-training: one classifier sees the text's content, the other the
page's metadata; in rounds each labels unlabelled documents it is sure of for the other.
Both are calibrated on labelled documents set aside, and their calibrated views combined."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BETWEEN_SPACES, Shared, byte_class, drop_ids, stage, text_slices, words

#: The fit uses about this many labelled documents, chosen by hash of their id, and all that have no label.
FIT_ROWS = 20_000
#: Rounds of exchanged labels, and Newton steps at most (a pass over the views each) after each of them.
ROUNDS, STEPS = 5, 6
#: How sure a view must be to label a document for the other, and the share of the pool it may label a round.
SURE, SHARE = 0.95, 0.1
#: How sure a view is, in bins of its logit.
_LEAST, _BIN, BINS = float(np.log(SURE / (1 - SURE))), 1 / 64, 2048
#: One labelled document in so many is set aside for calibration.
ASIDE = 5
#: With fewer of a label set aside, all labelled documents calibrate.
LEAST_ASIDE = 20
LANGS, SOURCES = 8, 16  # hash buckets of the metadata

_UPPER, _LOWER, _DIGIT = byte_class((65, 90)), byte_class((97, 122)), byte_class((48, 57))
_STOPS, _MARKS = byte_class((44, 44), (46, 46)), byte_class((33, 33), (63, 63))
_SIGNS = byte_class((35, 38), (42, 43), (60, 62), (64, 64), (92, 92), (94, 96), (123, 126))
_OTHER = byte_class((128, 255))
_CLASSES = (_UPPER, _LOWER, _DIGIT, _STOPS, _MARKS, _SIGNS, _OTHER)


# ------------------------------------------------------------------ views

def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def content_view(texts: pa.Array) -> np.ndarray:
    """What the words are like: shares of character classes, repeated words, word lengths."""
    w = words(texts, BETWEEN_SPACES, lower=False)
    n, size = w.count, np.maximum(np.diff(w.text), 1)
    count = np.maximum(n, 1)
    shares = [_per_text(c[w.data], w.text) / size for c in _CLASSES]
    again = np.zeros(len(w.hash))
    again[1:] = w.hash[1:] == w.hash[:-1]
    again[w.first[:-1][n > 0]] = 0
    length = (w.end - w.start).astype(float)
    tail = _SIGNS[w.data[w.end - 1]] | _MARKS[w.data[w.end - 1]] if len(w.hash) else np.zeros(0, bool)
    lone = (length == 1) & _SIGNS[w.data[w.start]] if len(w.hash) else np.zeros(0, bool)
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:])])
    mean = _per_text(length, w.first) / count
    return np.stack([*shares, _per_text(again, w.first) / count, _per_text(tail, w.first) / count,
                     _per_text(lone, w.first) / count, distinct / count, np.sqrt(distinct / count), mean,
                     np.sqrt(np.maximum(_per_text(length ** 2, w.first) / count - mean ** 2, 0)), np.log1p(n)], axis=1)


def _bucket(values: pa.Array, n: int) -> np.ndarray:
    """One-hot of a stable hash of each string; nulls are the last column."""
    out = np.zeros((len(values), n + 1))
    for i, v in enumerate(values.to_pylist()):
        out[i, n if v is None else zlib.crc32(v.encode()) % n] = 1
    return out


def metadata_view(lang: pa.Array, source: pa.Array, n_chars: pa.Array, texts: pa.Array) -> np.ndarray:
    """What is known about the page: language, source, stated size, number and length of lines."""
    stated = np.array([-1 if v is None else v for v in n_chars.to_pylist()], float)
    broken = np.array([0 if not t.is_valid else t.as_buffer().to_pybytes().count(b"\n") for t in texts], float)
    return np.concatenate([_bucket(lang, LANGS), _bucket(source, SOURCES), np.log1p(np.maximum(stated, 0))[:, None],
                           (stated < 0)[:, None], np.log1p(broken)[:, None],
                           np.log1p(np.maximum(stated, 0) / (1 + broken))[:, None]], axis=1)


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches, "text"):
        text = piece.column(1)
        content = content_view(text).astype(np.float32)
        meta = metadata_view(piece.column(2), piece.column(3), piece.column(4), text).astype(np.float32)
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), v.shape[1]).cast(pa.list_(pa.float32()))
                  for v in (content, meta)]
        yield pa.RecordBatch.from_arrays([piece.column(0), *arrays], names=["id", "content", "meta"])


# ------------------------------------------------------------------ classifiers

@dataclass
class Logistic:
    """Logistic regression on standardised columns."""
    shift: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray  # constant first

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.coefficients[0] + ((x - self.shift) / self.scale) @ self.coefficients[1:]


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -30, 30)))


def newton_sums(model: Logistic, x: np.ndarray, y: np.ndarray, weight: float | np.ndarray) -> np.ndarray:
    """What a Newton step needs of some rows, as one vector: curvature, then gradient."""
    z = np.concatenate([np.ones((len(x), 1)), (x - model.shift) / model.scale], axis=1)
    p = _sigmoid(model.logit(x))
    return np.concatenate([((z * (weight * p * (1 - p))[:, None]).T @ z).reshape(-1), z.T @ (weight * (y - p))])


def newton_step(model: Logistic, sums: np.ndarray, penalty: float = 1.0) -> float:
    """Moves the model by one step; the penalty spares the constant. Returns the size of the step."""
    c = model.coefficients
    ridge = np.diag([1e-6] + [penalty] * (len(c) - 1))
    step = np.linalg.solve(sums[:-len(c)].reshape(len(c), len(c)) + ridge, sums[-len(c):] - ridge @ c)
    model.coefficients = c + step
    return float(np.abs(step).max())


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, shift: np.ndarray | None = None,
                 scale: np.ndarray | None = None) -> Logistic:
    if shift is None:
        shift, scale = x.mean(axis=0), x.std(axis=0)
    model = Logistic(shift, np.where(scale > 1e-9, scale, 1.0), np.zeros(x.shape[1] + 1))
    for _ in range(30):
        if newton_step(model, newton_sums(model, x, y, weight)) < 1e-6:
            break
    return model


@dataclass
class Model:
    content: Logistic
    meta: Logistic
    combine: Logistic
    rounds: list[tuple[int, int]]  # pseudo-labels that content gave meta and meta gave content, by round

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: of the content view, the metadata view, and both."""
        a, b = self.content.logit(content), self.meta.logit(meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.combine.logit(np.stack([a, b], axis=1)))


# ------------------------------------------------------------------ co-training

@dataclass
class Round:
    """Both views' models of a round, and how sure (signed logit) each must be to give label 0 or 1."""
    models: list[Logistic]
    cuts: list[list[float]]  # by view, by label


def given_labels(rounds: list[Round], views: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The label (-1: none) that each view was given for some rows by the other one. It follows from the
    rounds' models and cuts alone, so no state of a row is kept anywhere."""
    given = [np.full(len(views[0]), -1) for _ in views]
    for r in rounds:
        for v in (0, 1):
            free, logit = given[1 - v] < 0, r.models[v].logit(views[v])
            for label, sure in ((0, -logit), (1, logit)):
                given[1 - v][free & (sure >= r.cuts[v][label])] = label
    return given


def moments(views) -> np.ndarray:
    """Rows, and sums and sums of squares of the columns of both views."""
    return np.concatenate([[len(views[0])], *[m for x in views for m in (x.sum(axis=0), (x * x).sum(axis=0))]])


def sure_counts(rounds: list[Round], models: list[Logistic], views) -> np.ndarray:
    """By view and label: rows without a label from that view, by bin of how sure it is of that label."""
    given = given_labels(rounds, views)
    out = np.zeros((2, 2, BINS))
    for v in (0, 1):
        logit = models[v].logit(views[v])[given[1 - v] < 0]
        for label, sure in ((0, -logit), (1, logit)):
            sure = sure[sure >= _LEAST]
            out[v, label] = np.bincount(np.minimum((sure - _LEAST) / _BIN, BINS - 1).astype(np.int64), minlength=BINS)
    return out.reshape(-1)


def given_sums(rounds: list[Round], models: list[Logistic], views) -> np.ndarray:
    """Newton sums of both views over the rows that have been given a label, which weigh one half."""
    given = given_labels(rounds, views)
    return np.concatenate([newton_sums(models[v], views[v][given[v] >= 0], given[v][given[v] >= 0], 0.5) for v in (0, 1)])


class Rows:
    """A pool of unlabelled documents in memory: the views' matrices."""

    def __init__(self, content: np.ndarray, meta: np.ndarray):
        self.views = (content, meta)

    def sums(self, function) -> np.ndarray:
        return function(self.views)


class StagedRows:
    """A pool in a staged table: each task reduces its rows to one vector, and Spark adds these up. They
    are added as decimals, so that the order does not matter."""

    def __init__(self, views: DataFrame):
        self.views = views

    def sums(self, function) -> np.ndarray:
        def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = function(tuple(_matrix(pa.chunked_array([batch.column(c)])) for c in (0, 1)))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["k", "v"])
        got = (self.views.select("content", "meta").mapInArrow(reduced, "k int, v double")
               .groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,12)")).cast("double").alias("v")).toArrow().sort_by("k"))
        return got.column("v").to_numpy()


def _cut(counts: np.ndarray, most: int) -> float:
    """The lowest bin from which on at most ``most`` rows lie; at least the surest bin that has any."""
    above = np.cumsum(counts[::-1])[::-1]
    fits = np.flatnonzero(above <= most)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return np.inf
    return _LEAST + _BIN * min(fits[0] if len(fits) else BINS, filled[-1])


def cotrain(content: np.ndarray, meta: np.ndarray, y: np.ndarray, aside: np.ndarray, pool, rounds: int = ROUNDS) -> Model:
    """Co-training on labelled rows (``y``; those ``aside`` only calibrate) and all rows of a pool without
    labels (``Rows`` or ``StagedRows``), which is only ever read through sums over it."""
    views, seed = (content, meta), ~aside
    rate = y[seed].mean()
    own = moments(tuple(x[seed] for x in views))
    pooled = pool.sums(moments) if pool is not None else np.zeros(0)
    n_pool = int(pooled[0]) if len(pooled) else 0
    total = own + pooled if n_pool else own
    models, at = [], 1
    for x in views:
        d = x.shape[1]
        shift = total[at:at + d] / total[0]
        scale = np.sqrt(np.maximum(total[at + d:at + 2 * d] / total[0] - shift ** 2, 0))
        models.append(fit_logistic(x[seed], y[seed], np.ones(seed.sum()), shift, scale))
        at += 2 * d
    done: list[Round] = []
    told: list[tuple[int, int]] = []
    for _ in range(rounds if n_pool else 0):
        held = [replace(m) for m in models]
        counts = pool.sums(partial(sure_counts, done, held)).reshape(2, 2, BINS)
        cuts = [[_cut(counts[v, label], int(np.ceil(SHARE * share * n_pool))) for label, share in ((0, 1 - rate), (1, rate))] for v in (0, 1)]
        taken = [int(sum(counts[v, label][_LEAST + _BIN * np.arange(BINS) >= cuts[v][label]].sum() for label in (0, 1))) for v in (0, 1)]
        told.append((taken[0], taken[1]))
        if not any(taken):
            break
        done.append(Round(held, cuts))
        for _ in range(STEPS):
            sums = pool.sums(partial(given_sums, done, models))
            edge = (content.shape[1] + 1) * (content.shape[1] + 2)
            size = [newton_step(models[v], part + newton_sums(models[v], views[v][seed], y[seed], np.ones(seed.sum())))
                    for v, part in ((0, sums[:edge]), (1, sums[edge:]))]
            if max(size) < 1e-3:
                break
    enough = min((y[aside] == 1).sum(), (y[aside] == 0).sum()) >= LEAST_ASIDE
    hold = aside if enough else np.ones(len(y), bool)
    logits = np.stack([m.logit(v[hold]) for m, v in zip(models, views)], axis=1)
    return Model(models[0], models[1], fit_logistic(logits, y[hold], np.ones(hold.sum())), told)


# ------------------------------------------------------------------ over a table

def _sampled(df: DataFrame, column: str, rows: int) -> DataFrame:
    """About ``rows`` rows, by hash of a column; all if there are no more."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(column, F.lit(11)), F.lit(1 << 40)) < int((1 << 40) * rows / n))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(float)


def learn(views: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
          fit_rows: int = FIT_ROWS) -> Model | None:
    """Fit on a sample of the labelled rows of the staged ``views`` and on all rows without a label; None
    without labels of both kinds. Ids with both labels count as good; null labels are no
    labels; rows that repeat an unlabelled id count as often as they occur."""
    marked = stage(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
                   .where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y")), "marked")
    chosen = stage(_sampled(marked, "id", fit_rows), "labelled")
    known = views.where("id is not null")
    got = (known.join(F.broadcast(chosen), "id").dropDuplicates(["id"])  # about fit_rows rows
           .withColumn("aside", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(ASIDE)) == 0).toArrow().sort_by("id"))
    y = np.array(got.column("y").to_pylist(), float)
    aside = np.array(got.column("aside").to_pylist(), bool)
    if len(np.unique(y)) < 2 or len(np.unique(y[~aside])) < 2:
        return None
    pool = stage(drop_ids(known, marked.select(F.col("id").alias("__marked")), "id"), "pool")
    return cotrain(_matrix(got.column("content")), _matrix(got.column("meta")), y, aside,
                   None if pool.isEmpty() else StagedRows(pool))


def _scored(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            content, meta = (_matrix(pa.chunked_array([batch.column(c)])) for c in (1, 2))
            a, b, both = m.score(content, meta) if m else (np.ones(n),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= 0.5)],
                                             names=["id", "content_score", "meta_score", "quality", "accepted"])
    return score


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``content_score``, ``meta_score``, ``quality`` (both views
    together; probabilities of good quality), ``accepted`` (quality >= 0.5).

    Null texts count as empty, null metadata as a value of its own, null ids stay and are not
    learned from. Without labels of both kinds every score is 1. Repeated rows give equal
    rows; no rows give no rows. Other columns are not read. Texts are read once; the views
    (about 180 bytes a document) are staged. Every round of the co-training reads those of all
    documents without a label, as sums that each task makes of its rows."""
    spark = docs.sparkSession
    views = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                              F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
                              F.col(size_col).cast("long").alias("n_chars"))
                  .mapInArrow(_views, "id long, content array<float>, meta array<float>"), "views")
    model = Shared(spark, learn(views, labels, id_col))
    return (views.mapInArrow(_scored(model), "id long, content_score double, meta_score double, quality double, accepted boolean")
            .withColumnRenamed("id", id_col))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``quality`` accepts, all columns. Rows that share an id with a
    rejected row go too; rows without an id stay."""
    lost = stage(quality(docs, labels, id_col).where("not accepted").select(F.col(id_col).alias("__low")).distinct(), "rejected")
    return drop_ids(docs, lost, id_col)
