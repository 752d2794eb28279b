import numpy as np
import pyarrow as pa

from liveness.llm import quality as Q
from liveness.session import table

from conftest import SMALL

from .cases import ROWS, clashing, docs, rows

LABELS = "doc_id long, quality int, toxic int"


def test_content_view_counts():
    v = Q.content_view(pa.array(["Aa a# a# !", None, "é"]))
    assert v.shape[0] == 3 and np.isfinite(v).all()
    assert v[0, 0] == 0.1 and v[0, 4] == 0.1          # one capital, one mark, of ten bytes
    assert v[0, 7] == 0.25 and v[0, 8] == 0.75        # one word repeats its neighbour; three end in a sign
    assert (v[1, :7] == 0).all()


def test_cotraining_exchanges_labels_and_gains():
    """Two views, each of which tells the classes apart; few labels, a large pool."""
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 4000)
    a, b = (np.stack([y + r.normal(size=4000) * s, r.normal(size=4000)], axis=1) for s in (0.3, 0.4))
    lab, pool, test = slice(0, 40), slice(40, 2000), slice(2000, 4000)
    m = Q.cotrain(a[lab], b[lab], y[lab].astype(float), np.arange(40) % 5 == 0, Q.Rows(a[pool], b[pool]))
    assert m.rounds[0][0] > 0 and m.rounds[0][1] > 0
    left, right, both = (np.mean((p >= 0.5) == y[test]) for p in m.score(a[test], b[test]))
    assert both >= max(left, right) - 0.005 and both > 0.95
    alone = Q.cotrain(a[lab], b[lab], y[lab].astype(float), np.arange(40) % 5 == 0, None)
    assert alone.rounds == []


def reference(views, y, aside, pool, n_rounds):
    """Co-training as it is told: lists of documents, a label book for each view, models fitted from nothing."""
    seed = [i for i in range(len(y)) if not aside[i]]
    shift, scale = [], []
    for v in (0, 1):
        every = np.concatenate([views[v][seed], pool[v]])
        shift.append(every.mean(axis=0))
        scale.append(np.where(every.std(axis=0) > 1e-9, every.std(axis=0), 1.0))
    book = [{}, {}]
    sizes = []

    def fit(v):
        x = np.concatenate([views[v][seed], pool[v][sorted(book[v])]])
        t = np.concatenate([y[seed], [book[v][i] for i in sorted(book[v])]])
        w = np.concatenate([np.ones(len(seed)), np.full(len(book[v]), 0.5)])
        return Q.fit_logistic(x, t, w, shift[v], scale[v])

    rate = np.mean(y[seed])
    for _ in range(n_rounds):
        models, told = [fit(0), fit(1)], []
        for v in (0, 1):
            logit, new = models[v].logit(pool[v]), {}
            for label, share in ((0, 1 - rate), (1, rate)):
                sure = {i: (1 if label else -1) * logit[i] for i in range(len(logit)) if i not in book[1 - v]}
                sure = {i: min(int((s - Q._LEAST) / Q._BIN), Q.BINS - 1) for i, s in sure.items() if s >= Q._LEAST}
                most = int(np.ceil(Q.SHARE * share * len(logit)))
                bins = sorted(set(sure.values()))
                cut = next((b for b in range(Q.BINS) if sum(x >= b for x in sure.values()) <= most), Q.BINS)
                cut = min(cut, bins[-1]) if bins else None
                new |= {i: label for i, b in sure.items() if b >= cut}
            told.append(new)
        book[1] |= told[0]
        book[0] |= told[1]
        sizes.append((len(told[0]), len(told[1])))
    return [fit(0), fit(1)], sizes


def _two_views(seed=4, n=1500):
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    return y.astype(float), *(np.stack([y + r.normal(size=n) * s, r.normal(size=n)], axis=1) for s in (0.3, 0.4))


def test_rounds_match_a_plain_definition():
    y, a, b = _two_views()
    aside = np.arange(60) % 5 == 0
    m = Q.cotrain(a[:60], b[:60], y[:60], aside, Q.Rows(a[60:], b[60:]), rounds=3)
    models, sizes = reference((a[:60], b[:60]), y[:60], aside, (a[60:], b[60:]), 3)
    assert m.rounds == sizes and sizes[0][0] > 0
    for got, want in zip((m.content, m.meta), models):
        assert np.allclose(got.coefficients, want.coefficients, atol=0.01)


def test_a_staged_pool_gives_what_rows_in_memory_give(spark):
    y, a, b = _two_views(n=800)
    a, b = a.astype(np.float32).astype(float), b.astype(np.float32).astype(float)
    pool = spark.createDataFrame([(list(map(float, a[i])), list(map(float, b[i]))) for i in range(60, 800)],
                                 "content array<float>, meta array<float>").repartition(5)
    aside = np.arange(60) % 5 == 0
    one, two = (Q.cotrain(a[:60], b[:60], y[:60], aside, p) for p in (Q.Rows(a[60:], b[60:]), Q.StagedRows(pool)))
    assert one.rounds == two.rounds
    assert np.allclose(one.meta.coefficients, two.meta.coefficients, atol=1e-5)


def test_every_unlabelled_document_takes_part():
    """A kind of page without any label, rare in a large pool, moves the metadata view: the content view is sure of it."""
    y, a, b = _two_views(n=30_000)
    rare = np.arange(len(y)) % 600 == 599  # 50 of 30,000
    y[rare] = 0
    a[rare] = [0.0 - 1.5, 0.0]
    b = np.concatenate([b, rare[:, None].astype(float)], axis=1)
    b[rare, 0] = 0.6
    lab = np.flatnonzero(~rare)[:60]
    pool = np.setdiff1d(np.arange(len(y)), lab)
    aside = np.arange(60) % 5 == 0
    with_ = Q.cotrain(a[lab], b[lab], y[lab], aside, Q.Rows(a[pool], b[pool]))
    without = Q.cotrain(a[lab], b[lab], y[lab], aside, Q.Rows(a[pool][~rare[pool]], b[pool][~rare[pool]]))
    assert with_.meta.logit(b[rare][:1])[0] < without.meta.logit(b[rare][:1])[0] - 0.5


def test_whole_values_are_hashed():
    names = [f"{i}.example.org" for i in range(40)]
    got = Q._bucket(pa.array(names + [None]), 16)
    assert len({tuple(r) for r in got[:-1]}) > 8 and got[-1, 16] == 1 and (got.sum(axis=1) == 1).all()


def test_odd_rows_and_no_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0), (9, 0, 0), (None, 1, 1), (5, None, 0), (5, 2, 0)], LABELS)
    got = Q.quality(clashing(docs(spark)), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.quality <= 1 and r.accepted == (r.quality >= 0.5) for r in got)
    none = spark.createDataFrame([], LABELS)
    assert all(r.accepted for r in Q.quality(docs(spark), none).collect())
    assert Q.quality(docs(spark, []), labels).count() == 0
    df = clashing(docs(spark))
    assert rows(Q.drop_rejected(df, none)) == rows(df)


def test_accuracy_on_documents_without_a_part_in_the_fit(spark):
    d = SMALL.replace("sf0.001", "sf0.1")
    labels = table(spark, d, "labels")
    seen = labels.where("doc_id % 3 != 0")
    got = Q.quality(table(spark, d, "documents"), seen).join(labels.where("doc_id % 3 = 0").select("doc_id", "quality")
                                                            .withColumnRenamed("quality", "y"), "doc_id").collect()
    good = [r for r in got if r.y == 1]
    bad = [r for r in got if r.y == 0]
    assert sum(r.accepted for r in good) >= 0.98 * len(good)
    assert sum(not r.accepted for r in bad) >= 0.9 * len(bad)
