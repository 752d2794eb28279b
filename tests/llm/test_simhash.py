"""SimHash groups against a brute-force definition; the index on any number of fingerprints."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from liveness.llm import simhash
from liveness.llm.simhash import _halfway_masks, _linked, segments, simhash_groups

from .cases import DOCS, ROWS, clashing, docs, lower, rows


def words_of(text):
    out, word = [], ""
    for ch in lower(text):
        if ch in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += ch
    return out + ([word] if word else [])


def fingerprint(text, width=4):
    w = words_of(text)
    shingles = [" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def closure(fps):
    """Component of each distinct fingerprint, by comparing all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {f: find(f) for f in root}


def expected(table):
    fps = [fingerprint(r[1]) for r in table]
    comp = closure(set(fps))
    big = 1 << 62
    least = lambda same: min((i if i is not None else big for i, f in same), default=big)
    out = []
    for r, f in zip(table, fps):
        c = least([(x[0], g) for x, g in zip(table, fps) if comp[g] == comp[f]])
        k = least([(x[0], g) for x, g in zip(table, fps) if g == f])
        out.append((r[0], f"{f:016x}", None if c == big else c, None if k == big else k))
    return sorted(out, key=repr)


def test_rows_that_every_operator_must_survive(spark):
    got = rows(simhash_groups(clashing(docs(spark))), "doc_id", "fingerprint", "component_id", "class_id")
    assert got == expected(ROWS)
    assert len(got) == len(ROWS)


def test_no_rows(spark):
    assert simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_given_documents_match_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = [tuple(r) for r in table.select("doc_id", "text").collect()]
    assert rows(simhash_groups(table), "doc_id", "fingerprint", "component_id", "class_id") == expected(plain)


def test_hash_is_sparks_own(spark):
    one = spark.createDataFrame([("the quick brown fox",)], "t string").select(F.hex(F.xxhash64("t"))).first()[0]
    assert fingerprint("the  QUICK\nbrown fox") == int(one, 16)


@pytest.mark.parametrize("n", [10, 1 << 17, 1 << 25, 1 << 40])
def test_no_pair_within_the_distance_is_missed(n):
    cuts = segments(n)
    assert sum(bits for _, bits, _ in cuts) == 64
    # worst case: every segment is one over its radius
    assert sum(radius + 1 for _, _, radius in cuts) > 4


@pytest.mark.parametrize(("n", "large"), [(100, 1 << 14), (1 << 17, 1 << 14), (1 << 30, 1 << 14), (1 << 17, 3)])
def test_links_connect_what_is_near(spark, n, large):
    """A dense cluster, chains and strays, with every layout of the index and with large groups met halfway."""
    rng = np.random.default_rng(5)
    fps = {0, (1 << 64) - 1}
    for base in rng.integers(0, 1 << 63, 6, dtype=np.uint64):
        at = int(base)
        for _ in range(25):  # a walk in steps of up to five bits
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                at ^= 1 << int(b)
            fps.add(at)
        fps |= {int(base) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (20, 2))}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [tuple(r) for r in _linked(classes, n, large).distinct().collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in links)
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = lambda of: sorted(sorted(g for g in signed if of(g) == r) for r in {of(g) for g in signed})
    want = closure(fps)
    assert groups(find) == groups(lambda s: want[s & ((1 << 64) - 1)])


def test_a_large_group_gives_a_forest():
    fps = np.unique(np.array([1 << int(b) for b in range(64)] + [0], np.uint64))
    found = [len(x) for x, _ in simhash._forest(fps)]
    assert sum(found) == len(fps) - 1


def test_masks():
    assert len(_halfway_masks()) == 1 + 64 + 64 * 63 // 2
