"""Skew-safe ordering operators equal their window-based definitions, with one key
holding a third of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from liveness.operators import ordering as O


def _rows(n=3000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rnd.randrange(40)}"
        rows.append((i, g, rnd.randrange(50), rnd.random()))
    return rows


def test_top_n_per_group_equals_window(spark):
    df = spark.createDataFrame(_rows(), "id long, g string, ts int, v double")
    order = [F.col("ts").desc(), F.col("id").desc()]
    got = O.top_n_per_group(df, ["g"], order, 7).select("id", "rank").collect()
    w = Window.partitionBy("g").orderBy(*order)
    exp = df.withColumn("rank", F.row_number().over(w)).where("rank <= 7").select("id", "rank").collect()
    assert sorted(got) == sorted(exp)


def test_latest_and_first_equal_window(spark):
    df = spark.createDataFrame(_rows(), "id long, g string, ts int, v double")
    got = O.latest_per_key(df, ["g"], ["ts", "id"]).select("g", "id").collect()
    w = Window.partitionBy("g").orderBy(F.col("ts").desc(), F.col("id").desc())
    exp = df.withColumn("r", F.row_number().over(w)).where("r = 1").select("g", "id").collect()
    assert sorted(got) == sorted(exp)
    got_first = O.first_seen(df, ["g"], ["ts", "id"]).select("g", "id").collect()
    w2 = Window.partitionBy("g").orderBy("ts", "id")
    exp_first = df.withColumn("r", F.row_number().over(w2)).where("r = 1").select("g", "id").collect()
    assert sorted(got_first) == sorted(exp_first)


def test_paginate_groups(spark):
    df = spark.createDataFrame(_rows(), "id long, g string, ts int, v double")
    got = O.paginate(df, ["id"], page=3, per_page=5, group="g").where("g = 'hot'").select("id").collect()
    ids = sorted(r.id for r in df.where("g = 'hot'").select("id").collect())
    assert sorted(r.id for r in got) == ids[10:15]


def test_positions_within_equals_row_number(spark):
    df = spark.createDataFrame(_rows(5000, seed=11), "id long, g string, ts int, v double")
    order = [F.col("ts").desc(), F.col("id").asc()]
    got = O.positions_within(df, "g", order, out="pos", partitions=7).select("id", "pos").collect()
    w = Window.partitionBy("g").orderBy(*order)
    exp = df.withColumn("pos", F.row_number().over(w)).select("id", "pos").collect()
    assert sorted(got) == sorted(exp)


def test_sort_results_equals_window(spark):
    from liveness.plans.views import scored_results
    from conftest import SMALL
    r = scored_results(spark, SMALL)
    a = O.sort_results(r, mode="confidence").select("entity_id", "sort_pos").collect()
    w = Window.partitionBy("file_name").orderBy(F.col("confidence").desc(), F.col("entity_id"))
    b = r.select("entity_id", F.row_number().over(w).alias("sort_pos")).collect()
    assert len(a) == r.count() and sorted(a) == sorted(b)


def test_running_sums_equal_window(spark):
    df = spark.createDataFrame(_rows(4000, seed=7), "id long, g string, ts int, v double")
    order = [F.col("ts").desc(), F.col("id")]
    got = O.running_sums(df, order, ["id"], partitions=6).select("id", "cum_id", "all_id").collect()
    w = Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("id", F.sum("id").over(w), F.sum("id").over(Window.partitionBy(F.lit(1)))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exp))


def _attach(kind, entities, calls):
    from liveness.operators import joins, rollups
    if kind == "attach_usage":
        return joins.attach_usage(entities, rollups.callee_usage(calls))
    if kind == "attach_call_count":
        return joins.attach_call_count(entities, rollups.call_counts(calls))
    return joins.attach_test_usage(entities, rollups.test_called_names(calls))


@pytest.mark.parametrize("kind", ["attach_usage", "attach_call_count", "attach_test_usage"])
def test_hot_name_is_split_in_the_feature_joins(spark, kind):
    """A third of all entities under one name: no partition of the join is above twice the median. AQE's own
    splitting is off, so that the joins are judged as they are written."""
    from liveness.session import materialize
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.enabled",
                                           "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ids = spark.range(0, 900_000, 1, 16)
        name = F.when(F.col("id") % 3 == 0, F.lit("__init__")).otherwise(F.concat(F.lit("f"), (F.col("id") % 5000).cast("string")))
        entities = materialize(ids.select("id", name.alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("snippet")), "hot")
        calls = ids.limit(200_000).select(name.alias("callee"), (F.col("id") % 2 == 0).alias("in_test_file"))
        out = _attach(kind, entities, calls)
        rows = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert sum(rows) == 900_000
        assert rows[-1] <= 2 * rows[len(rows) // 2]
        plain = entities.join(_attach(kind, entities.select("name").distinct(), calls), "name")
        assert out.select("id", *plain.columns[3:]).exceptAll(plain.select("id", *plain.columns[3:])).isEmpty()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_heavy_keys_and_null_keys(spark):
    from liveness.operators.skew import heavy_keys, split_join
    left = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None)
                                      .otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    assert set(heavy_keys(left, "k", 0.1)) == {"hot", None}
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k5", 3), (None, 4)], "r string, v int")
    got = {r.v: r.n for r in split_join(left, right, "k", "r").groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: 20_000, 2: 1, 3: 1, None: 39_998}
    assert split_join(left.limit(0), right, "k", "r").count() == 0
    # nulls alone are hot: they meet nothing, and need no partition of their own
    rest = left.where("k is null or k <> 'hot'")
    assert heavy_keys(rest, "k", 0.1) == [None]
    got = {r.v: r.n for r in split_join(rest, right, "k", "r", heavy=[None]).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {2: 1, 3: 1, None: 39_998}


def test_a_repeated_name_meets_a_question_once(spark):
    """100,000 symbols of one file share eight names; the look-up's join gives at most eight rows a question."""
    from liveness.operators.joins import symbol_named_in_text
    symbols = spark.range(100_000).select(F.lit("f").alias("file_name"), F.col("id").alias("entity_id"),
                                          (F.lit(200_000) - F.col("id")).cast("int").alias("start_line"),
                                          F.concat(F.lit("name"), (F.col("id") % 8).cast("string")).alias("name"))
    q = spark.createDataFrame([(1, "f", "explain NAME3 or name5"), (2, "f", "nothing")], "question_id long, file_name string, text string")
    got = {r.question_id: r.sym_entity_id for r in symbol_named_in_text(q, symbols).collect()}
    # the first by start line: the largest id with name3 or name5
    assert got == {1: 99_997, 2: None}


def test_names_and_questions_of_a_hot_file_are_dealt_over_blocks(spark):
    """Any dealing gives the definition: the first symbol whose lower-cased name is in the lower-cased text."""
    from liveness.operators.joins import symbol_named_in_text
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abÄé_0", k=rnd.randint(1, 4)))
    symbols = [("hot" if i % 3 else f"f{i % 5}", i, rnd.randrange(50), word() if i % 40 else rnd.choice(["", None]), [f"r{i}"]) for i in range(300)]
    texts = [(i, "hot" if i % 3 else f"f{i % 7}", rnd.choice(["", None, " ".join(word() for _ in range(rnd.randint(0, 6))).upper()]))
             for i in range(200)]
    sym = spark.createDataFrame(symbols, "file_name string, entity_id long, start_line int, name string, reasons array<string>")
    asked = spark.createDataFrame(texts, "question_id long, file_name string, text string")
    want = {}
    for i, file, text in texts:
        found = sorted((line, e) for f, e, line, n, _ in symbols if n and f == file and text is not None and n.lower() in text.lower())
        want[i] = found[0][1] if found else None
    for block, chunk in ((100_000, 20_000), (7, 11)):
        got = symbol_named_in_text(asked, sym, names_per_block=block, questions_per_chunk=chunk).collect()
        assert {r.question_id: r.sym_entity_id for r in got} == want
        assert all(r.sym_reasons == (None if r.sym_entity_id is None else [f"r{r.sym_entity_id}"]) for r in got)


def test_a_text_is_read_once_whatever_the_names(spark):
    """One text of two million characters and 20,000 names: linear, and no row but the answer."""
    import time

    from liveness.operators.joins import symbol_named_in_text
    symbols = spark.range(20_000).select(F.lit("f").alias("file_name"), F.col("id").alias("entity_id"), F.lit(1).alias("start_line"),
                                         F.concat(F.lit("name_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"))
    text = "x" * 1_000_000 + " " + "name_00" * 140_000 + "name_001234 name_000777"
    q = spark.createDataFrame([(1, "f", text)], "question_id long, file_name string, text string")
    symbol_named_in_text(q.limit(0), symbols).collect()
    began = time.time()
    assert symbol_named_in_text(q, symbols).first().sym_entity_id == 777
    assert time.time() - began < 30


def test_lists_are_written_once_for_all_questions(spark):
    """2,000 questions on one file of 3,000 symbols: rows are their sum, not their product."""
    from liveness.operators.questions import answer_questions, expand_answers
    results = spark.range(3000).select(F.lit("f").alias("file_name"), F.col("id").alias("entity_id"), F.concat(F.lit("fn_"), "id").alias("name"),
                                       F.col("id").cast("int").alias("start_line"), (F.col("id") + 1).cast("int").alias("end_line"),
                                       (F.col("id") / 3000).alias("confidence"))
    kinds = ["is it safe to remove?", "why?", "summary", "explain fn_7 please", "how many dead?"]
    asked = spark.createDataFrame([(i, "f" if i % 10 else "g", kinds[i % 5]) for i in range(2000)], "question_id long, file_name string, text string")
    answers, items = answer_questions(asked, results)
    sizes = {r.list_id: r.n for r in items.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k.split("|")[0]: n for k, n in sizes.items() if not k.startswith("about")} == {"removable": 750, "symbols": 3000, "summary": 5}
    got = {r.question_id: r for r in answers.collect()}
    assert len(got) == 2000 and all(r.n_items == sizes.get(r.list_id, 0) for r in got.values())
    assert got[10].list_id is None  # no results for that file
    one = expand_answers(answers.where("question_id = 11"), items).orderBy("item_no").collect()
    assert len(one) == 3001 and one[0].text.startswith("That symbol was not found") and one[1].text.startswith("fn_0 - 0%")
