import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from liveness.llm import decontamination as D
from liveness.llm.common import stage

from .cases import ROWS, clashing, docs, lower, rows

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def brute(data, items, width=10):
    windows = set()
    for item, text in items:
        w = WORD.findall(lower(text))
        size = min(width, len(w))
        windows |= {(item, tuple(w[i:i + size])) for i in range(len(w) - size + 1) if size}
    out = []
    for doc, text, *_ in data:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for item, run in windows:
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i:i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    found.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 30
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(30)]
    items += [(None, "null item words"), (3, "second row of item three"), (40, None), (41, items[5][1])]
    data = []
    for i in range(120):
        text = r.choices(vocabulary, k=r.choice([0, 3, 12, 60]))
        for _ in range(r.choice([0, 0, 1, 2])):
            w = WORD.findall(r.choice(items)[1] or "")
            a = r.randrange(len(w) + 1)
            at = r.randrange(len(text) + 1)
            text[at:at] = w[a:a + r.choice([9, 10, 15])]
        data.append((i, ", ".join(text).title(), "en", "a", 1))
    return data, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block_words", [1 << 18, 40])
def test_matches_brute_force(spark, seed, block_words):
    data, items = corpus(seed)
    data = data + ROWS + data[:3]
    got = D.contamination(clashing(docs(spark, data)), spark.createDataFrame(items, ITEMS), block_words=block_words)
    assert rows(got, *COLUMNS) == brute(data, items)


def test_many_candidates_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 7)
    data, items = corpus(5)
    got = D.contamination(docs(spark, data), spark.createDataFrame(items, ITEMS))
    assert rows(got, *COLUMNS) == brute(data, items)


def test_large_benchmark_with_hot_words_and_copies(spark):
    """By shuffle: items of one frequent word, one window in every third document, and as many copies without an id."""
    data, items = corpus(7)
    passage = " ".join(f"p{i}" for i in range(14))
    items = items + [(100, "the"), (101, "the the"), (102, passage), (103, passage), (104, f"{passage} never seen")]
    data = data + [(1000 + i, f"the {passage} w{i % 7}", "en", "a", 1) for i in range(60)]
    data = data + [(None, f"the the {passage}", "en", "a", 1)] * 60
    got = D.contamination(docs(spark, data), spark.createDataFrame(items, ITEMS), block_words=1)
    assert rows(got, *COLUMNS) == brute(data, items)


def test_both_ways_give_the_same_spans(spark):
    data, items = corpus(8)
    few, many = (rows(D.contamination(docs(spark, data), spark.createDataFrame(items, ITEMS), block_words=n),
                      "doc_id", "hit_starts", "hit_ends") for n in (1 << 18, 1))
    assert few == many


def test_a_hot_key_is_dealt_over_tasks(spark):
    """Two thirds of all rows under one key: none is lost, and no part holds more than its share."""
    left = stage(spark.range(9000).selectExpr("IF(id % 3 = 0, id, -1) AS k", "id AS row"), "left")
    right = spark.createDataFrame([(-1, "a"), (-1, "b"), (3, "c"), (7, "d")], "k long, v string")
    got = D.dealt_join(left, right, "k", F.col("row"), "left")
    assert got.where("k = -1").groupBy("v").count().orderBy("v").collect() == [("a", 6000), ("b", 6000)]
    assert got.where("k >= 0").count() == 3000 and got.where("v IN ('c', 'd')").count() == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in D.dealt_join(left, right, "k", F.col("row"), "left").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 2 and max(sizes) < 12000


def test_empty_tables_of_a_large_benchmark(spark):
    item = spark.createDataFrame([(1, "some words that make one item")], ITEMS)
    assert D.contamination(docs(spark, []), item, block_words=0).count() == 0
    assert rows(D.contamination(docs(spark), item, block_words=0), *COLUMNS) == brute(ROWS, [(1, "some words that make one item")])


def test_spans_are_word_offsets(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], ITEMS)
    got = D.contamination(docs(spark, [(1, "x A b C d e f g h i j k y", "en", "a", 1)]), items).first()
    assert (got.hit_starts, got.hit_ends, got.n_hit) == ([1], [12], 11)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert D.contamination(docs(spark, []), none).count() == 0
    assert rows(D.contamination(docs(spark), none), *COLUMNS) == brute(ROWS, [])
    assert D.drop_contaminated(docs(spark), none).count() == len(ROWS)


def test_drop(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again")], ITEMS)
    left = D.drop_contaminated(clashing(docs(spark)), items)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [3, 4, 5, 6, 7, 8, 9, 10]
