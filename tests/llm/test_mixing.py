import re

import pytest

from liveness.llm import mixing as M

from .cases import ROWS, clashing, docs, rows

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Targets by source: shares by weight, stopped at three times the size, the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


def sizes_of(data):
    found = {}
    for r in data:
        found[r[3]] = found.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    return found


def corpus(n=900):
    # one source with a third of all rows, small sources that reach their limit, sources of equal rank of weight
    out = []
    for i in range(n):
        s = "s0" if i % 3 == 0 else f"s{1 + i % 11}" if i % 7 else ["é", "tiny", "Z", None][i % 4]
        out.append((i, "w " * (1 + i * 37 % 50 if s != "tiny" else i % 2), "en", s, 1))
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_targets_sums_and_limits(spark, block):
    data = corpus()
    want, sizes = brute_targets(sizes_of(data)), sizes_of(data)
    source = {r[0]: r[3] for r in data}
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    got = M.mix_sources(clashing(docs(spark, data)), block=block).collect()
    assert len(got) == len(data)
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(WORD.findall(data[r.doc_id][1])) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], rel=1e-9)
        assert r.taken == r.copies * r.size <= 3 * r.size
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate + 1e-9), int(rate + 1e-9) + 1) or r.size == 0
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6


def test_reruns_agree_whatever_the_partitions(spark):
    df = docs(spark, corpus(300))
    assert rows(M.mix_sources(df.repartition(2))) == rows(M.mix_sources(df.repartition(9)))


def test_every_document_has_its_chance(spark):
    """Over many documents the mean number of copies nears target / source_size, for short and for long ones."""
    data = [(i, "w " * (1 if i % 2 else 30), "en", "ab"[i % 4 == 0], 1) for i in range(6000)]
    gaps = {}
    for r in M.mix_sources(docs(spark, data), block=16).collect():
        gaps.setdefault((data[r.doc_id][3], r.size), []).append(r.copies - r.target / r.source_size)
    for g in gaps.values():
        assert abs(sum(g) / len(g)) < 0.04


def test_odd_rows(spark):
    got = M.mix_sources(clashing(docs(spark)))
    assert got.count() == len(ROWS)
    want = brute_targets(sizes_of(ROWS))
    assert {round(r.target, 6) for r in got.collect()} == {round(t, 6) for t in want.values()}
    assert all(r.taken == 0 for r in got.where("size = 0").collect())


def test_empty_and_wordless(spark):
    assert M.mix_sources(docs(spark, [])).count() == 0
    got = M.mix_sources(docs(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)])).collect()
    assert {(r.size, r.target, r.taken) for r in got} == {(0, 0.0, 0)}


def test_rows_that_agree_in_id_and_size_are_in_many_blocks(spark, monkeypatch):
    """Copies of one text without an id do not meet in one block, and their words add up to the target."""
    rounded = M._rounded
    monkeypatch.setattr(M, "_rounded", lambda items: M.F.when(M.F.size(items) > 200, M.F.raise_error(M.F.lit("block"))).otherwise(rounded(items)))
    data = [(None, "w " * 7, "en", "a", 1)] * 3000 + [(i, "w " * (1 + i % 9), "en", "b", 1) for i in range(3000)]
    got = M.mix_sources(docs(spark, data), block=16).collect()
    twins = [r for r in got if r.doc_id is None]
    assert len(got) == 6000 and len(twins) == 3000 and all(r.size == 7 for r in twins)
    assert abs(sum(r.taken for r in twins) - twins[0].target) <= 7


def test_many_twins_are_numbered_once(spark):
    sizes = spark.createDataFrame([("=a", None, 7)] * 2500 + [("=a", 1, 7), ("=b", None, 7)], "key string, id long, size long")
    got = M._numbered(sizes).collect()
    assert sorted(r.twin for r in got if r.key == "=a" and r.id is None) == list(range(2500))
    assert len(got) == 2502 and {r.twin for r in got if r.key != "=a" or r.id} == {0}
