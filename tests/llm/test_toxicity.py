import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from liveness.llm import toxicity as T
from liveness.llm.common import ALPHANUMERIC, words

from conftest import SMALL

from .cases import ROWS, clashing, docs, rows


def brute_marginals(emission, moves):
    """Sum over all paths."""
    n = len(emission)
    total, on = 0.0, np.zeros(n)
    for path in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(e * y for e, y in zip(emission, path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += weight
        on += weight * np.array(path)
    return on / total


def test_marginals_match_all_paths():
    r = np.random.default_rng(1)
    sizes = [3, 0, 1, 6, 2, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emission, moves = r.normal(size=sum(sizes)) * 2, r.normal(size=(2, 2))
    got = T.marginals(emission, first, moves)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert got[a:b] == pytest.approx(brute_marginals(emission[a:b], moves))
    assert len(T.marginals(np.zeros(0), np.zeros(3, np.int64), moves)) == 0


def test_prefix_features_agree_between_words():
    w = words(pa.array(["lostraei lostra", "LOSTRAschaft é"]), ALPHANUMERIC)
    f = T.features(w)
    k = 1 + T.PREFIXES.index(6)
    assert f[0, k] == f[1, k] == f[2, k] != 0 and f[3, k] == 0 and len(set(f[:, 0].tolist())) == 4


def corpus(n=600):
    r = np.random.default_rng(5)
    plain = [f"word{i}" for i in range(300)]
    data, labels = [], []
    for i in range(n):
        text = list(r.choice(plain, r.integers(5, 80)))
        toxic = i % 5 == 0
        for _ in range(r.integers(2, 5) if toxic else 0):
            text.insert(int(r.integers(len(text))), str(r.choice(["scumbag", "grumfel", "grumfix", "grumfow"])))
        data.append((i, " ".join(text), "en", "a", 1))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return data, labels


LABELS = "doc_id long, quality int, toxic int"


def test_scores_held_out_rows(spark):
    data, labels = corpus()
    got = T.toxicity(clashing(docs(spark, data + ROWS[3:])), spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], LABELS)).collect()
    assert len(got) == len(data) + len(ROWS) - 3
    for r in got[:len(data)]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 11}
    assert all(by_id[i].predicted == (i % 5 == 0) for i in by_id)
    spans = [by_id[15].toxic_spans.split(",")][0]
    text = data[15][1]
    assert {text[int(s.split(":")[0]):int(s.split(":")[1])][:5] for s in spans} <= {"scumb", "grumf"}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_held_out_labels_do_not_matter(spark):
    data, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    scores = [rows(T.toxicity(docs(spark, data), spark.createDataFrame(x, LABELS)), "doc_id", "score") for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in T.toxicity(docs(spark), none).collect()} == {0}
    assert T.toxicity(docs(spark, []), none).count() == 0


def test_accuracy_on_held_out_documents(spark):
    from liveness.session import table
    d = SMALL.replace("sf0.001", "sf0.1")
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    got = T.toxicity(table(spark, d, "documents"), table(spark, d, "labels")).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    # about six of the 97 are labelled toxic without a toxic word
    assert hit >= 0.9 * sum(r.toxic for r in got) and hit >= 0.95 * sum(r.predicted for r in got)


def test_long_texts_are_learned_from(spark):
    """All toxic labels are on texts of more than 10,000 characters."""
    data, labels = corpus()
    plain = " ".join(f"word{i % 300}" for i in range(1800))
    data = [(i, f"{t} {plain}" if i % 5 == 0 else t, *rest) for i, t, *rest in data]
    got = T.toxicity(docs(spark, data), spark.createDataFrame(labels, LABELS)).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in got if r.doc_id)


def test_rare_toxic_words_of_a_large_corpus(spark):
    """A word of 5 among 1,000 toxic documents (under 1 %) is found."""
    texts = [(i, f"plain text number {i % 50} " + ("scumbag scumbag" if i % 2 else "and more"), "en", "a", 1) for i in range(2600)]
    rare = [(9000 + i, f"plain text number {i} grumfel grumfel", "en", "a", 1) for i in range(60) if zlib.crc32(str(9000 + i).encode()) % 5][:5]
    data = [(i, t + f" w{i} v{i}", *rest) for i, t, *rest in texts + rare]
    labels = [(i, 1, int("scumbag" in t or "grumfel" in t)) for i, t, *_ in data]
    got = T.toxicity(docs(spark, data + [(20000, "plain text number 7 grumfel grumfel", "en", "a", 1)]), spark.createDataFrame(labels, LABELS))
    assert got.where("doc_id = 20000").first().predicted == 1


def test_copies_count_once_together(spark):
    copies = [(i, "the same toxic text of many copies here", "en", "a", 1) for i in range(40)]
    other = [(100 + i, f"some text of its own number {i} indeed", "en", "a", 1) for i in range(3)]
    texts = docs(spark, copies + other + [(200, None, "en", "a", 0)]).selectExpr("doc_id AS lid", "1 AS y", "text")
    got = {r.wid: r.weight for r in T.weighted(texts).collect()}
    assert all(got[i] == pytest.approx(1 / 40) for i in range(40)) and all(got[100 + i] == 1 for i in range(3))


def test_filter_passes_what_was_put_in_and_little_else(spark):
    r = np.random.default_rng(3)
    put = np.concatenate([r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1), [np.uint64(0), np.uint64((1 << 64) - 1)]])
    frame = spark.createDataFrame([(int(v),) for v in put.view(np.int64)], "feature long")
    f = T.Filter(frame)
    assert f.passes(put).all()
    other = r.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    assert f.passes(other).mean() < 0.001


def test_the_lexicon_is_bounded_by_a_parameter(spark):
    data, labels = corpus()
    y = {i: t for i, _, t in labels}
    texts = spark.createDataFrame([(d[0], y[d[0]], d[1]) for d in data if d[0] in y], "lid long, y int, text string")
    whole, few = T._lexicon(texts, 1000), T._lexicon(texts, 2)
    assert 2 <= len(few) <= 4 and set(few) <= set(whole) and len(whole) > 4


def test_an_id_on_many_texts_does_not_widen_the_sample(spark, monkeypatch):
    """An id on 500 toxic texts: the fit sees no more than ``fit_rows`` texts of each label."""
    data, labels = corpus()
    many = [(7, f"{data[15][1]} grumfel n{i}", "en", "a", 1) for i in range(500)]
    sizes = []
    fit = T._logistic
    monkeypatch.setattr(T, "_logistic", lambda x, y, **k: sizes.append(len(x)) or fit(x, y, **k))
    T.learn(docs(spark, data + many), spark.createDataFrame(labels + [(7, 1, 1)], LABELS), fit_rows=50)
    assert sizes[0] <= 100


def test_a_word_is_toxic_in_one_context_and_harmless_in_another(spark):
    """"word1 strike word2" stands in toxic documents only, "word3 strike word4" as often in clean as in toxic ones; the neighbours
    are common everywhere. The lexicon marks both uses, the chain one."""
    r = np.random.default_rng(11)
    plain = [f"word{i}" for i in range(300)]
    data, labels = [], []
    for i in range(1500):
        text = list(r.choice(plain, r.integers(10, 60)))
        toxic = i % 5 == 0
        uses = (["word1 strike word2"] if toxic else []) + (["word3 strike word4"] if i % 12 == 1 else [])
        for use in uses:
            text.insert(int(r.integers(len(text))), use)
        data.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    data += [(5000, "word7 word8 word1 strike word2 word9", "en", "a", 1), (5001, "word7 word8 word3 strike word4 word9", "en", "a", 1)]
    frame = docs(spark, data)
    model = T.learn(frame, spark.createDataFrame(labels, LABELS))
    w = words(pa.array([data[-2][1], data[-1][1]]), ALPHANUMERIC)
    p = T.marginals(model.emissions(w), w.first, model.moves)
    strike = words(pa.array(["strike"]), ALPHANUMERIC).hash[0]
    assert strike in model.keys  # the lexicon cannot tell the uses apart
    hit, harmless = p[np.flatnonzero(w.hash == strike)]
    assert hit > 0.5 > harmless
    got = {r.doc_id: r for r in T.toxicity(frame, spark.createDataFrame(labels, LABELS)).collect()}
    assert (got[5000].predicted, got[5001].predicted) == (1, 0) and got[5001].toxic_spans == ""
    wrong = [i for i in range(1500) if got[i].held_out and got[i].predicted != (i % 5 == 0)]
    assert not wrong


def test_neighbours_stay_inside_their_text():
    w = words(pa.array(["a b", "", "c", "b a"]), ALPHANUMERIC)
    got = T.neighbours(w, np.arange(5))
    none = 2 * T.CONTEXT
    assert got[0, 0] == got[1, 1] == got[2, 0] == got[2, 1] == got[3, 0] == got[4, 1] == none
    assert got[0, 1] - T.CONTEXT == got[4, 0] and got[1, 0] == got[3, 1] - T.CONTEXT  # b after a, b before a; a likewise
