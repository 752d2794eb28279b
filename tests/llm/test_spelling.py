"""Spelling variants against an all-pairs definition, and the index against edit distance."""

import random
import re
import zlib
from collections import Counter

import pytest

from liveness.llm import spelling
from liveness.llm.common import stage
from liveness.llm.spelling import Index, near_words, runs, spelling_variants

from .cases import DOCS, ROWS, clashing, docs, lower, rows


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(table, least=5, count=3, one_in=97):
    n = Counter()
    for r in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            word = run[:h % len(run)] + run[h % len(run) + 1:] if h % one_in == 0 else run
            if len(word) >= least:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= count}
    form, near_n = {}, {}
    for w in n:
        near = sorted((v for v in n if is_near(w, v)), key=lambda v: (-n[v], v))
        near_n[w] = len(near)
        form[w] = near[0] if near and n[near[0]] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near_n[w], n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def some_docs(seed, n_docs=60):
    rng = random.Random(seed)
    letters = "abcdeé"
    stems = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(25)]

    def slip(w):
        i, c, kind = rng.randrange(len(w) + 1), rng.choice(letters), rng.randrange(6)
        return w[:i] + c + w[i:] if kind == 0 else w[:i] + w[i + 1:] if kind == 1 else w[:i] + c + w[i + 1:] if kind == 2 else w

    text = lambda: rng.choice([" ", "-", "1"]).join(slip(rng.choice(stems)).title() if rng.random() < .2 else slip(slip(rng.choice(stems)))
                                                    for _ in range(80))
    return [(i, text(), "en", "a", 0) for i in range(n_docs)]


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_all_pairs_definition(spark, block):
    table = some_docs(3)
    got = rows(spelling_variants(docs(spark, table), block=block), *COLUMNS)
    assert got == expected(table)
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_rows_that_every_operator_must_survive(spark):
    table = ROWS + some_docs(4, 5)
    assert rows(spelling_variants(clashing(docs(spark, table))), *COLUMNS) == expected(table)


def test_no_rows(spark):
    assert spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling_variants(docs(spark, [(1, None, None, None, None), (2, "", "", "", 0)])).count() == 0


def test_index_tracks_one_error_at_every_place():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(300)})
    index = Index(words)
    for w in words + ["zzz", "a"]:
        found = index.near(w, (len(w) - 1, len(w), len(w) + 1))
        assert [v for i, v in enumerate(words) if found >> i & 1] == [v for v in words if is_near(w, v)]


def test_each_pair_is_counted_in_one_bucket(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(5, 8))) for _ in range(400)})
    vocabulary = stage(spark.createDataFrame([(w, 10 + i) for i, w in enumerate(words)], "word string, n long"), "vocabulary")
    for block in (10_000, 16):
        got = {r["word"]: (r["n_near"], r["best"]) for r in near_words(vocabulary, block).collect()}
        want = {w: [v for v in words if is_near(w, v)] for w in words}
        assert got == {w: (len(v), max(v, key=words.index)) for w, v in want.items() if v}


def test_long_text_in_pieces(monkeypatch):
    text = "abcdef ghijk " * 500
    whole = runs(text, 5)
    monkeypatch.setattr(spelling, "_PIECE", 100)
    assert runs(text, 5) == whole == {"abcdef": 500, "ghijk": 500}
    assert runs("x" * 1000, 5) == {"x" * 1000: 1}


def test_a_long_path_of_forms(spark):
    forms = stage(spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(20)] + [("hot%d" % i, "w00") for i in range(50)],
                                        "word string, form string"), "forms")
    got = spelling.roots(spark, forms).collect()
    assert len(got) == 70 and {r["root"] for r in got} == {"w20"}
