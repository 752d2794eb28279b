"""Toxic spans and document scores from a linear-chain conditional random field.

Token labels come from the document labels: words, or beginnings of words, that toxic
documents share and clean ones lack mark the toxic tokens. A two-state chain (clean, toxic)
is fitted to labelled stretches of tokens; its features are a token's own and, for one that has any, the words
beside it, so that a word may be toxic in one context and harmless in another. Marks that the fitted chain
denies are taken back, all but the surest of a document, and the chain is fitted again. Over every whole text, forward-backward gives
each token's probability of being toxic. Sum and maximum of these make the document's
score, tokens of one half or more its offending spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (ALPHANUMERIC, _BYTE, _P, SLICE_BYTES, Shared, Words, bounded, join_by_count, mix, runs_hash, stage, text_slices,
                     words)

#: Chain and calibration are fitted to this many labelled documents of each label at most (by
#: hash of the id), of any length, and at most this many stretches of one document. Lexicon and scores read everything.
FIT_ROWS, FIT_STRETCHES = 2500, 16
#: Beginnings of words, in bytes, that are features beside the word itself.
PREFIXES = (4, 5, 6)
#: A toxic feature is in this many toxic documents (copies counted once), ...
SUPPORT = 4
#: ... and this many times as frequent there as in clean ones; less for texts without strong features.
RATIO, WEAK_RATIO = 30.0, 5.0
STRETCH = 24
#: Values of the word before a marked token, and of the word after it (by hash); what they weigh costs this much more
#: than other weights, so that a neighbour must be met often to count.
CONTEXT, CONTEXT_PENALTY = 1 << 12, 0.5
#: Times the chain is fitted at most; it ends when no mark is taken back.
FITS = 3
#: Words in sequence that tell the copies of a text.
RUN = 5
#: Strong features of the model at most, and weak ones at most: those that set most documents apart.
LEXICON = 1 << 16
#: Features a task counts before it hands them on.
COUNTED = 1 << 20
#: Text bytes whose chains are run side by side in a task.
LOCKSTEP_BYTES = 1 << 24


# ------------------------------------------------------------------ features

def features(w: Words) -> np.ndarray:
    """(words, 1 + prefixes) hashes; 0 where a word is shorter than a prefix."""
    out = np.zeros((len(w.hash), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = w.hash
    size, total, scale = w.end - w.start, np.zeros(len(w.hash), np.uint64), 1
    last = len(w.data) - 1
    for i in range(max(PREFIXES)):
        total += _BYTE[w.data[np.minimum(w.start + i, last)]] * np.uint64(scale)
        scale = scale * _P % (1 << 64)
        if i + 1 in PREFIXES:
            out[:, 1 + PREFIXES.index(i + 1)] = np.where(size > i, mix(total ^ np.uint64(i + 1)), np.uint64(0))
    return out


def neighbours(w: Words, at: np.ndarray) -> np.ndarray:
    """(len(at), 2) values of the words before and after the words ``at``; 2 * CONTEXT at an end of the text."""
    out = np.full((len(at), 2), 2 * CONTEXT, np.int32)
    if len(at):
        value, own = (w.hash >> np.uint64(64 - CONTEXT.bit_length() + 1)).astype(np.int32), w.owner[at]
        before, after = at > w.first[own], at + 1 < w.first[own + 1]
        out[before, 0] = value[at[before] - 1]
        out[after, 1] = value[at[after] + 1] + CONTEXT
    return out


@dataclass
class Model:
    """Toxic features (sorted hashes) with their weights, those of neighbours, chain potentials, document calibration."""
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    context: np.ndarray = field(default_factory=lambda: np.zeros(2 * CONTEXT))
    bias: float = -8.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log potentials, from and to
    document: np.ndarray = field(default_factory=lambda: np.array([-6.0, 0, 0, 0, 0]))  # of ``evidence``

    def index(self, f: np.ndarray) -> np.ndarray:
        """Place of each feature among the keys, or len(keys)."""
        if not len(self.keys):
            return np.zeros(f.shape, np.int32)
        flags = np.zeros(1 << 16, bool)
        flags[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        out = np.full(f.shape, len(self.keys), np.int32)
        maybe = flags[(f >> np.uint64(48)).astype(np.int64)]
        some = f[maybe]
        at = np.searchsorted(self.keys, some).clip(max=len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == some, at, len(self.keys))
        return out

    def emissions(self, w: Words) -> np.ndarray:
        """Log odds of "toxic" of each token by itself."""
        if not len(w.hash):
            return np.zeros(0)
        at = self.index(features(w))
        out = self.bias + np.append(self.weights, 0.0)[at].sum(axis=1)
        marked = np.flatnonzero((at < len(self.keys)).any(axis=1))
        out[marked] += np.append(self.context, 0.0)[neighbours(w, marked)].sum(axis=1)
        return out

    def score(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(evidence(total, most) @ self.document)))


def evidence(total: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Columns of the document's calibration: a constant, the first and the second expected
    toxic token, how many there are, the surest one."""
    return np.stack([np.ones(len(total)), np.minimum(total, 1), np.clip(total - 1, 0, 1), np.log1p(total), most], axis=1)


# ------------------------------------------------------------------ forward-backward

def messages(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of all chains at once, as ratios of toxic to clean: a
    token's odds are their product. Chains are stepped side by side, longest first, so a step
    is a few operations on the chains still running."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    steps = int(sizes.max()) if len(sizes) else 0
    if not steps:
        return np.zeros(0), np.zeros(0)
    running = np.searchsorted(-sizes[order], -np.arange(steps), side="left")  # chains longer than t
    begin = np.concatenate([[0], np.cumsum(running)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = begin[np.arange(len(emission)) - first[owner]] + rank[owner]
    odds = np.empty(len(emission))
    odds[place] = np.exp(np.clip(emission, -40, 40))
    stay, enter, leave, remain = np.exp(moves).reshape(-1)
    forward, now = np.empty(len(emission)), None
    for t in range(steps):
        e = odds[begin[t]:begin[t + 1]]
        now = e.copy() if now is None else e * ((enter + remain * now[:len(e)]) / (stay + leave * now[:len(e)]))
        forward[begin[t]:begin[t + 1]] = now
    backward, now = np.empty(len(emission)), np.ones(0)
    for t in range(steps - 1, -1, -1):
        if len(now) < running[t]:  # chains that end here
            now = np.concatenate([now, np.ones(running[t] - len(now))])
        backward[begin[t]:begin[t + 1]] = now
        ahead = odds[begin[t]:begin[t + 1]] * now
        now = (leave + remain * ahead) / (stay + enter * ahead)
    return forward[place], backward[place]


def marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(token is toxic) of all chains."""
    forward, backward = messages(emission, first, moves)
    both = forward * backward
    return both / (1 + both)


# ------------------------------------------------------------------ fit

def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _groups(w: Words) -> np.ndarray:
    """Copies of a text are told by its smallest hash of ``RUN`` words in sequence, those of a shorter
    one by all its words."""
    out = np.zeros(len(w.count), np.uint64)
    runs = runs_hash(w.hash, RUN)
    own = w.owner[:len(runs)]
    inside = np.arange(len(runs)) + RUN <= w.first[own + 1]
    runs, own = runs[inside], own[inside]
    if len(runs):
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[begins]] = np.minimum.reduceat(runs, begins)
    for i in np.flatnonzero((w.count > 0) & (w.count < RUN)):
        out[i] = mix(w.hash[w.first[i]:w.first[i + 1]]).sum()
    return out


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches, "text"):
        group = _groups(words(piece.column(2), ALPHANUMERIC))
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(group.view(np.int64))], names=["lid", "y", "group"])


def weighted(texts: DataFrame) -> DataFrame:
    """(lid, weight): a text with c copies of its label counts 1 / c, so that copies count once together. An id on
    several rows has the mean of their weights. Copies are counted and joined by Spark, a hot group apart."""
    rows = stage(texts.mapInArrow(_copies, "lid long, y int, group long")
                 .withColumn("copy", F.xxhash64("y", "group")), "copies")
    counts = stage(rows.groupBy("copy").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("c")), "copy-counts")
    return stage(join_by_count(rows, counts, "copy", "n").groupBy(F.col("lid").alias("wid")).agg(F.avg(1 / F.col("c")).alias("weight")), "weights")


class Filter:
    """Bits of features, by 27 bits of their hash: passes all that were put in and few others. 16 MB whatever
    the number of features; what passes wrongly is left out by a join later."""

    BITS = 27

    def __init__(self, features: DataFrame):
        place = F.shiftrightunsigned("feature", 64 - self.BITS)
        bits = features.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")) \
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        self.bits = np.zeros(1 << (self.BITS - 3), np.uint8)
        for bucket, raw in zip(*(c.to_pylist() for c in bits.toArrow().columns)):  # 4,097 rows of 4 KB at most
            # bucket k holds the values 32768 * (k - 1) + 1 to 32768 * k, by position from 0
            at = (32768 * (bucket - 1) + 1 + np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))) if bucket else np.zeros(1, np.int64)
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def passes(self, f: np.ndarray) -> np.ndarray:
        place = (f >> np.uint64(64 - self.BITS)).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _counted(known=None, strong=None):
    """(feature, weight of the documents with it) of the texts of a task. ``known``: a filter of features; ``strong``:
    only texts without two tokens that have one of those."""
    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(at, np.concatenate(counts), minlength=len(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for piece in text_slices(batches, "text"):
            w = words(piece.column(2), ALPHANUMERIC)
            f, owner, weight = features(w), w.owner, piece.column(3).to_numpy(zero_copy_only=False)
            if strong is not None:
                held = Model(strong.value).index(f).min(axis=1, initial=len(strong.value)) < len(strong.value)
                left = np.bincount(owner[held], minlength=piece.num_rows) < 2
                f, owner = f[left[owner]], owner[left[owner]]
            for column in f.T:  # the word, then each beginning: their hashes differ
                ok = column != 0
                if known is not None:
                    ok &= known.value.passes(column)
                _, one = np.unique(mix(column[ok]) ^ mix(owner[ok].astype(np.uint64) + np.uint64(1)), return_index=True)
                if len(one):
                    k, n = merged([column[ok][one]], [weight[owner[ok][one]]])
                    keys.append(k)
                    counts.append(n)
                    size += len(k)
            if size > COUNTED:
                k, n = merged(keys, counts)
                keys, counts, size = [k], [n], len(k)
                if size > COUNTED // 2:
                    yield _pairs(k, n)
                    keys, counts, size = [], [], 0
        if size:
            yield _pairs(*merged(keys, counts))
    return run


def _pairs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["feature", "n"])


def _lexicon(texts: DataFrame, size: int) -> np.ndarray:
    """Features that toxic documents share and clean ones lack, counted by Spark over all of
    ``texts`` (lid, y, text): of those, the ``size`` that set most documents apart. The counts stay in Spark; the
    driver sees a filter of fixed size and the features it returns."""
    spark = texts.sparkSession
    weights = weighted(texts)
    sizes = {r.y: r.n for r in texts.select("lid", "y").join(bounded(weights), F.col("lid") == F.col("wid"))
             .groupBy("y").agg(F.sum("weight").alias("n")).collect()}
    none = np.zeros(0, np.uint64)
    if not sizes.get(0) or not sizes.get(1):
        return none
    rows = texts.join(bounded(weights), F.col("lid") == F.col("wid")).select("lid", "y", "text", "weight")

    def counts(y: int, **only) -> DataFrame:
        return (rows.where(F.col("y") == y).mapInArrow(_counted(**only), "feature long, n double")
                .groupBy("feature").agg(F.sum("n").alias("n")))

    often = F.col("n") > SUPPORT - 1e-6  # the shares of copies do not add up to the last digit
    toxic = stage(counts(1).where(often), "toxic-features")
    ratio = (F.col("n") / sizes[1]) / ((F.coalesce("m", F.lit(0.0)) + 0.5) / sizes[0])
    clean = counts(0, known=Shared(spark, Filter(toxic))).withColumnRenamed("n", "m")
    apart = (F.round(F.col("n") * F.log("ratio"), 6).desc(), "feature")
    found = stage(toxic.join(clean, "feature", "left").withColumn("ratio", ratio).where(F.col("ratio") >= WEAK_RATIO), "lexicon")
    keys = np.sort(_unsigned(found.where(F.col("ratio") >= RATIO).orderBy(*apart).limit(size).select("feature").toArrow().column(0)))
    # weaker features only for toxic texts that have no two tokens with a strong one
    rest = found.where(F.col("ratio") < RATIO)
    if rest.isEmpty():
        return keys
    more = counts(1, known=Shared(spark, Filter(rest)), strong=Shared(spark, keys)).where(often).select("feature")
    weak = rest.join(more, "feature", "left_semi").orderBy(*apart).limit(size).select("feature")
    return np.union1d(keys, _unsigned(weak.toArrow().column(0)))


def _stretches(w: Words, at: np.ndarray, tagged: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, ...]:
    """Labelled stretches of ``STRETCH`` tokens: around tokens with a toxic feature (spread over
    the text if there are many), and one from the middle of every text. Features (n, STRETCH, k), neighbours
    (n, STRETCH, 2), labels, which tokens exist, and the text of each."""
    middle = w.first[:-1] + w.count // 2
    owner = w.owner
    centre = np.unique(np.flatnonzero(tagged) // (STRETCH // 2) * (STRETCH // 2) + STRETCH // 4)
    centre = centre[centre < len(w.hash)]
    n = np.bincount(owner[centre], minlength=len(w.count))
    turn = np.arange(len(centre)) - (np.cumsum(n) - n)[owner[centre]]
    of, most = n[owner[centre]], FIT_STRETCHES - 1
    centre = centre[(of <= most) | (turn * most // np.maximum(of, 1) != (turn - 1) * most // np.maximum(of, 1))]
    centre = np.unique(np.concatenate([centre, middle[w.count > 0]]))
    pos = centre[:, None] - STRETCH // 2 + np.arange(STRETCH)
    exists = (pos >= w.first[owner[centre]][:, None]) & (pos < w.first[owner[centre] + 1][:, None])
    pos = pos.clip(0, len(w.hash) - 1)
    near = neighbours(w, pos.reshape(-1)).reshape(*pos.shape, 2)
    return at[pos], near, tagged[pos] & toxic[owner[pos]] & exists, exists, owner[centre]


def _sampled(model):
    """The stretches of each text: features, neighbours, labels and existing tokens as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for piece in text_slices(batches, "text"):
            w = words(piece.column(2), ALPHANUMERIC)
            if not len(w.hash):
                continue
            at = m.index(features(w))
            y = piece.column(1).to_numpy(zero_copy_only=False) == 1
            got, near, label, exists, own = _stretches(w, at, (at < len(m.keys)).any(axis=1), y)
            raw = [pa.array([x.tobytes() for x in v], pa.binary())
                   for v in (got.astype(np.int32), near.astype(np.uint16), label, exists)]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(own)), *raw], names=["lid", "at", "near", "label", "exists"])
    return run


def _summed(model):
    """Sum and maximum of the marginals of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for piece in text_slices(batches, "text"):
            w = words(piece.column(2), ALPHANUMERIC)
            total, most = _totals(marginals(m.emissions(w), w.first, m.moves), w.first)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(total), pa.array(most)],
                                             names=["lid", "y", "total", "most"])
    return run


def _fit_chain(model: Model, at: np.ndarray, near: np.ndarray, label: np.ndarray, exists: np.ndarray, document: np.ndarray) -> None:
    """Fit, take back the marks that the chain denies, fit again. A toxic document keeps the mark that is surest,
    as its label says that something in it is toxic. Stretches are packed to their existing tokens."""
    sizes = exists.sum(axis=1)
    first = np.concatenate([[0], np.cumsum(sizes)])
    at, near, y = at[exists], near[exists], label[exists].astype(float)
    _, own = np.unique(np.repeat(document, sizes), return_inverse=True)
    for _ in range(FITS):
        p = _likeliest(model, at, near, y, first)
        surest = np.zeros(own.max(initial=-1) + 1)
        np.maximum.at(surest, own, p * y)
        denied = (y > 0) & (p < 0.5) & (p < surest[own])
        if not denied.any():
            break
        y[denied] = 0


def _likeliest(model: Model, at: np.ndarray, near: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Maximum likelihood with a small penalty: gradients by forward-backward over all
    stretches, steps by Adam. Gives the marginals of all tokens."""
    n, c, k = len(model.keys), 2 * CONTEXT, at.shape[1]
    marked = np.flatnonzero((at < n).any(axis=1))
    near = near[marked]
    follows = np.ones(len(y), bool)
    follows[first[:-1][np.diff(first) > 0]] = False
    later = np.flatnonzero(follows)
    par = np.concatenate([np.full(n, 2.0), np.zeros(c), [-3.0], np.zeros(4)])  # weights, context, bias, moves
    penalty = np.full(len(par), 0.02)
    penalty[n:n + c] = CONTEXT_PENALTY
    m, v = np.zeros_like(par), np.zeros_like(par)
    for r in range(1, rounds + 1):
        moves = par[n + c + 1:].reshape(2, 2)
        e = par[n + c] + np.append(par[:n], 0.0)[at].sum(axis=1)
        e[marked] += np.append(par[n:n + c], 0.0)[near].sum(axis=1)
        forward, backward = messages(e, first, moves)
        both = forward * backward
        p = both / (1 + both)
        gap = y - p
        g = np.zeros_like(par)
        g[:n] = np.bincount(at.reshape(-1), np.repeat(gap, k), minlength=n + 1)[:n]
        g[n:n + c] = np.bincount(near.reshape(-1), np.repeat(gap[marked], 2), minlength=c + 1)[:c]
        g[n + c] = gap.sum()
        # expected moves between neighbours, from the same messages
        ahead = np.exp(np.clip(e[later], -40, 40)) * backward[later]
        pair = np.exp(moves).reshape(-1)[:, None] * np.stack([np.ones(len(later)), ahead, forward[later - 1], forward[later - 1] * ahead])
        expected = (pair / pair.sum(axis=0)).sum(axis=1)
        g[n + c + 1:] = np.bincount((2 * y[later - 1] + y[later]).astype(np.int64), minlength=4) - expected
        g = g - penalty * par
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        par = par + 0.1 * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
    model.weights, model.context = par[:n], par[n:n + c]
    model.bias, model.moves = float(par[n + c]), par[n + c + 1:].reshape(2, 2)
    return p


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Newton steps for a logistic regression whose first column is the constant."""
    c = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ c).clip(-30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(c))
        c = c + np.linalg.solve(h, x.T @ (y - p) - penalty * c)
    return c


def _totals(p: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and maximum of the marginals of each text; 0 without words."""
    total, most = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        total[full], most[full] = np.add.reduceat(p, first[full]), np.maximum.reduceat(p, first[full])
    return total, most


# ------------------------------------------------------------------ over a table

def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for group in text_slices(batches, "text", LOCKSTEP_BYTES):
            emission, starts, ends, counts = [], [], [], []
            for piece in text_slices(iter([group]), "text", SLICE_BYTES):
                w = words(piece.column(2), ALPHANUMERIC)
                emission.append(m.emissions(w))
                char = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before a byte
                base = np.repeat(char[w.text[:-1]], w.count)
                starts.append((char[w.start] - base).astype(np.int32))
                ends.append((char[w.end] - base).astype(np.int32))
                counts.append(w.count)
            first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            p = marginals(np.concatenate(emission), first, m.moves)
            total, most = _totals(p, first)
            score = m.score(total, most)
            spans = [""] * group.num_rows
            bad = np.flatnonzero(p >= 0.5)
            start, end = np.concatenate(starts), np.concatenate(ends)
            own = np.searchsorted(first, bad, side="right") - 1
            for d in np.unique(own):
                spans[d] = ",".join(f"{start[t]}:{end[t]}" for t in bad[own == d])
            yield pa.RecordBatch.from_arrays([group.column(0), group.column(1), pa.array(score),
                                              pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.string())],
                                             names=["id", "held_out", "score", "predicted", "toxic_spans"])
    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          fit_rows: int = FIT_ROWS) -> Model:
    """The lexicon from all labelled documents; chain and calibration from at most ``fit_rows`` texts of
    each label, the first by hash of id and text, whatever their length. Rows held out are never
    read. Ids with both labels count as toxic; null labels are no labels. Without texts of both
    labels, nothing is toxic."""
    model = Model()
    marked = stage(labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y"))
                   .where(F.col("y").isin(0, 1) & F.col("lid").isNotNull() & ~held_out("lid"))
                   .groupBy("lid").agg(F.max("y").alias("y")), "labelled")
    if marked.select("y").distinct().count() < 2:
        return model
    source = docs.select(F.col(id_col).alias("lid"), F.col(text_col).cast("string").alias("text"))
    texts = source.join(bounded(marked), "lid").select("lid", "y", "text")
    model.keys = _lexicon(texts, LEXICON)
    # rows, not ids: an id may be on any number of texts
    present = stage(texts.select(F.col("lid").alias("cid"), "y", F.xxhash64("text").alias("text_hash")).distinct(), "labelled-documents")
    chosen = None
    for y in (0, 1):
        part = present.where(F.col("y") == y).orderBy(F.xxhash64("cid", "text_hash"), "cid", "text_hash").limit(fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = stage(chosen, "sample")  # 2 * fit_rows rows at most
    if chosen.select("y").distinct().count() < 2:
        return model
    sample = (source.join(F.broadcast(chosen), (F.col("lid") == F.col("cid")) & (F.xxhash64("text") == F.col("text_hash")))
              .select("lid", "y", "text"))
    if len(model.keys):
        got = (sample.mapInArrow(_sampled(Shared(docs.sparkSession, model)), "lid long, at binary, near binary, label binary, exists binary")
               .distinct().toArrow().sort_by([(c, "ascending") for c in ("lid", "at", "near", "label", "exists")]))
        at, near, label, exists = (np.frombuffer(b"".join(got.column(c).to_pylist()), kind).reshape(got.num_rows, STRETCH, -1)
                                   for c, kind in (("at", np.int32), ("near", np.uint16), ("label", bool), ("exists", bool)))
        _fit_chain(model, at, near, label[:, :, 0], exists[:, :, 0], got.column("lid").to_numpy())
    sums = (sample.mapInArrow(_summed(Shared(docs.sparkSession, model)), "lid long, y int, total double, most double")
            .groupBy("lid", "y").agg(F.max(F.struct("total", "most")).alias("s"))
            .select("lid", "y", "s.total", "s.most").toArrow().sort_by("lid"))
    model.document = _logistic(evidence(sums.column("total").to_numpy(), sums.column("most").to_numpy()),
                               sums.column("y").to_numpy().astype(float), penalty=0.1)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if
    score >= 0.5), ``toxic_spans`` (start:end of toxic tokens, code points, comma-joined).

    Scores depend on the text alone. Null and empty texts have the score of a text without
    toxic tokens. Null ids are not held out. Repeated rows give equal rows; no rows give no
    rows; without labels of both kinds nothing is predicted toxic. Other columns are not
    read. What the driver fits is bounded (see ``learn``); scoring is one pass without a shuffle."""
    model = Shared(docs.sparkSession, learn(docs, labels, id_col, text_col))
    return (docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"),
                        F.col(text_col).cast("string").alias("text"))
            .mapInArrow(_score(model), "id long, held_out boolean, score double, predicted int, toxic_spans string")
            .withColumnRenamed("id", id_col))
