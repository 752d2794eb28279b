import random
import re

import numpy as np
import pytest

from liveness.llm import near_dedup as N
from liveness.llm.components import components

from .cases import ROWS, clashing, docs, lower, rows

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(data, width, percent=80):
    sets = [shingles(r[1], width) for r in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(data)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        low = min((data[i][0] for i in g if data[i][0] is not None), default=None)
        out += [(data[i][0], len(sets[i]), low, data[i][0] == low) for i in g]
    return sorted(out, key=repr)


def corpus(seed, n=300):
    """Texts with chains of edits, copies, and unrelated texts that share passages."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=30)
    texts = []
    while len(texts) < n:
        if texts and r.random() < 0.6:
            t = list(r.choice(texts))
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                if t:
                    t[r.randrange(len(t))] = r.choice(vocabulary)
        else:
            t = r.choices(vocabulary, k=r.choice([1, 2, 4, 5, 6, 10, 40, 120]))
            if r.random() < 0.3:
                t += passage
        texts.append(t)
    return [(i, " ".join(t).title(), "en", "a", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("width,seed", [(2, 1), (5, 3)])
def test_matches_brute_force(spark, width, seed):
    data = corpus(seed) + [(r[0] + 1000 if r[0] else None, *r[1:]) for r in ROWS]
    got = N.near_duplicates(clashing(docs(spark, data)), width=width)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute(data, width)


def test_blocks_of_a_key_are_compared_with_each_other(spark, monkeypatch):
    """After one round with hubs, all that is left goes through blocks of three classes."""
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "WORTH", 2.0)
    data = corpus(9, 200)
    assert rows(N.near_duplicates(docs(spark, data), width=2), "doc_id", "n_shingles", "component_id", "kept") == brute(data, 2)


def test_first_shared_key():
    r = np.random.default_rng(0)
    differ = r.random((300, N.HASHES)) < 0.25
    places = dict(N._chunk_places())
    for row, got in zip(differ, N._first_place(differ)):
        assert got == min((o for o, p in places.items() if not row[p].any()), default=N.HASHES)


def test_links_between_classes_off_the_first_hub(spark):
    """A chain whose ends are far apart, and under one key classes that the hub is not linked with."""
    base = [f"w{i}" for i in range(100)]
    data = []
    for i in range(12):
        t = list(base)
        for j in range(i * 4):
            t[(j * 7) % 100] = f"x{j}"
        data.append((i, " ".join(t), "en", "a", 1))
    assert rows(N.near_duplicates(docs(spark, data), width=2), "doc_id", "n_shingles", "component_id", "kept") == brute(data, 2)


def test_pairs_within_the_distance_share_a_key():
    r = np.random.default_rng(3)
    places = N._chunk_places()
    for _ in range(300):
        differ = np.zeros(N.HASHES, bool)
        differ[r.choice(N.HASHES, N.DISTANCE, replace=False)] = True
        assert any(not differ[p].any() for _, p in places)


def test_a_group_of_copies_is_one_class(spark):
    data = [(i, "same words in every one of these rows here", "en", "a", 1) for i in range(500)]
    got = N.near_duplicates(docs(spark, data)).collect()
    assert {r.component_id for r in got} == {0} and len({r.class_id for r in got}) == 1


def test_empty(spark):
    assert N.near_duplicates(docs(spark, [])).count() == 0
    assert N.drop_near_duplicates(docs(spark, [])).count() == 0


def test_drop_keeps_one_row_of_each_group(spark):
    df = clashing(docs(spark))
    left = N.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("links", [[(1, 1)], [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)],
                                   [(5, 3), (3, 5), (9, 8), (8, 7), (1, 9), (20, 21)]])
def test_components(spark, links):
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        for x in (a, b):
            root.setdefault(x, x)
    for _ in range(len(links) + 1):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in links)}
