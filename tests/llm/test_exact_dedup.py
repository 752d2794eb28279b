import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from liveness.llm import exact_dedup as X

from .cases import ROWS, clashing, docs, lower, rows


@given(st.sets(st.integers(0, 2 ** 48 - 1), min_size=1, max_size=300), st.integers(0, 1000))
@settings(max_examples=60, deadline=None)
def test_golomb_code_round_trip(values, shift):
    v = np.array(sorted(values), np.uint64) + np.uint64(shift)
    k, code = X.encode(v, shift)
    assert (X.decode(code, len(v), k, shift) == v).all()


def brute(data):
    groups = defaultdict(list)
    for k, r in enumerate(data):
        groups[lower(r[1])].append((r[0] is not None, r[0] or 0, k, r[0]))
    out = []
    for text, members in groups.items():
        keep = max(members)
        for m in members:
            out.append((m[3], keep[3], len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("owners", [1, 5])
def test_matches_brute_force(spark, owners):
    got = X.exact_duplicates(clashing(docs(spark)).repartition(3), owners=owners)
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == brute(ROWS)
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == len({lower(r[1]) for r in ROWS})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty(spark):
    assert X.exact_duplicates(docs(spark, [])).count() == 0
    assert X.drop_duplicates(docs(spark, [])).count() == 0


def test_colliding_fingerprints_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(X, "FINGERPRINT_BITS", 8)  # 256 fingerprints: every row is suspected
    data = [(i, f"text {i % 500}", "en", "a", 1) for i in range(1000)]
    got = X.exact_duplicates(docs(spark, data), owners=3)
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == brute(data)


def test_hot_text_is_one_entry_per_sender(spark):
    data = [(i, "same text" if i % 3 == 0 else f"own {i}", "en", "a", 1) for i in range(3000)]
    got = X.exact_duplicates(docs(spark, data).repartition(6))
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == brute(data)


def test_shuffle_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(X.common, "BROADCAST_IDS", 0)
    assert rows(X.exact_duplicates(docs(spark)), "doc_id", "keep_id", "group_size", "text_sha256") == brute(ROWS)


def test_drop_keeps_columns_and_one_row_per_text(spark):
    df = clashing(docs(spark))
    left = X.drop_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [2, 4, 5, 6, 7, 8, 10]
    assert left.where("doc_id is null").count() == 2
