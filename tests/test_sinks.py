"""Counts that come with the write, pages from a seek index, the request filter of the cache."""

import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from liveness.operators import ordering as O
from liveness.operators import users as U
from liveness.operators.joins import explanation_cache_miss, requested
from liveness.sources import io as IO


def _counted(spark, df):
    """The same rows, and an accumulator of how many were computed."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns, schema=b.schema)

    return df.mapInArrow(through, df.schema), seen


def test_the_input_of_a_write_is_computed_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df, seen = _counted(spark, spark.range(0, 1000, 1, 4))
    assert IO.write_table_if_any(df, path)
    assert seen.value == 1000 and spark.read.parquet(path).count() == 1000
    df, seen = _counted(spark, spark.range(0, 70, 1, 4))
    assert IO.write_table_if_any(df, path)
    assert seen.value == 70 and spark.read.parquet(path).count() == 70  # replaced, not added


def test_an_empty_input_leaves_what_is_there(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not IO.write_table_if_any(spark.range(5).where("id > 9"), path)
    assert os.listdir(tmp_path) == []
    IO.write_table_if_any(spark.range(5), path)
    assert not IO.write_table_if_any(spark.createDataFrame([], "id long"), path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]


def test_legacy_rows_are_read_once(spark, tmp_path):
    existing = spark.createDataFrame([("0" * 8, "Old", "old@x.org", False)], "user_id string, name string, email string, active boolean")
    lines = spark.createDataFrame([(i, f"n{i}", f"u{i % 30}@x.org") for i in range(90)], "line_no long, name string, email string")
    legacy, seen = _counted(spark, lines.repartition(5))
    users, count = U.import_users(existing, legacy, "line_no")
    plan = users._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "CollectMetrics" in plan
    users.write.parquet(str(tmp_path / "users"))
    assert U.imported(count) == 90 and seen.value == 90
    got = spark.read.parquet(str(tmp_path / "users"))
    assert got.count() == 31 and {r.name for r in got.where("email = 'u3@x.org'").collect()} == {"n63"}


def test_legacy_without_rows(spark):
    existing = spark.createDataFrame([("0" * 8, "Old", "old@x.org", False)], "user_id string, name string, email string, active boolean")
    none = spark.createDataFrame([], "line_no long, name string, email string")
    users, count = U.import_users(existing, none, "line_no")
    assert users.count() == 1 and U.imported(count) == 0


def test_a_deep_page_reads_one_range(spark):
    n = 1_200_000
    df = spark.range(0, n, 1, 8).select(((F.col("id") * 7919) % n).alias("k"), F.col("id").cast("string").alias("v"))
    index = O.page_index(df, ["k"], partitions=16)
    assert index.starts[-1] == n
    for page in (1, 2, 60_000, 100_000, 120_000, 120_001):
        got = index.page(page, 10)
        assert [r.k for r in got.collect()] == list(range((page - 1) * 10, min(page * 10, n)))
        files = {f.rsplit("/", 2)[-2] for f in got.inputFiles()}
        assert len(files) <= 1 or page == 120_001
    # a page that lies in two ranges, and one larger than several
    edge = index.starts[3]
    page = edge // 1000 + 1
    assert [r.k for r in index.page(page, 1000).collect()] == list(range((page - 1) * 1000, page * 1000))
    assert index.page(2, 500_000).count() == 500_000


def test_pages_with_ties_descending_and_none(spark):
    rows = [(i, i // 40, None if i % 50 == 0 else i) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g long, x long")
    order = [F.col("g").desc(), F.col("id")]
    index = O.page_index(df, order, partitions=7)
    want = [r.id for r in df.orderBy(*order).collect()]
    assert [r.id for p in range(1, 9) for r in index.page(p, 70).collect()] == want
    assert O.page_index(df.where("false"), ["id"]).page(1, 5).count() == 0
    assert index.page(9, 70).count() == 0 and index.page(1, 3).columns == df.columns


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"g{i % 3}") for i in range(300)], "id long, g string")
    plain = [sorted(map(tuple, O.paginate(df, ["id"], 4, 20, group=g).select("id", "g").collect())) for g in (None, "g")]
    monkeypatch.setattr(O, "SHALLOW", 5)
    assert [sorted(map(tuple, O.paginate(df, ["id"], 4, 20, group=g).select("id", "g").collect())) for g in (None, "g")] == plain


def test_cache_miss_does_not_depend_on_partitioning(spark):
    rnd = random.Random(4)
    rows = [(f"k{rnd.randrange(60)}" if i % 20 else None, i % 7, rnd.choice(["a", None, "b"])) for i in range(800)]
    cache = spark.createDataFrame([(f"k{i}", "x") for i in range(0, 90, 3)] + [(None, "x")], "content_key string, said string")
    schema = "content_key string, a int, b string"
    results = []
    for parts in (1, 3, 11):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, schema).repartition(parts)
        results.append(sorted((tuple(r) for r in explanation_cache_miss(df, cache).collect()), key=repr))
    assert results[0] == results[1] == results[2]
    keys = {r[0] for r in rows}
    assert {r[0] for r in results[0]} == {k for k in keys if k is None or int(k[1:]) % 3}
    first = min((r for r in rows if r[0] == results[0][1][0]), key=lambda r: (r[1], r[2] is not None, r[2] or ""))
    assert first in results[0]


def test_the_cache_is_filtered_where_it_is_read(spark):
    """Of a cache of 200,000 rows only those that may be requested pass: all that are, and few others."""
    cache = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_key"))
    requests = spark.range(0, 2_000_000, 1000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_key"), F.col("id").alias("x"))
    got = requested(cache, requests, "content_key")
    assert got.join(requests, "content_key", "left_semi").count() == 200
    assert got.count() < 200 + 200_000 * 0.01
    plan = explanation_cache_miss(requests, cache)._jdf.queryExecution().executedPlan().toString()
    # the cache's scan meets the filter by a broadcast join before anything of it is shuffled
    assert "BroadcastHashJoin" in plan
    assert explanation_cache_miss(requests, cache).count() == 2000 - 200
    assert explanation_cache_miss(requests.limit(0), cache).count() == 0
    assert explanation_cache_miss(requests, cache.limit(0)).count() == 2000


def test_a_job_deletes_what_it_has_staged(spark, tmp_path):
    from liveness.session import materialize, scratch
    other = materialize(spark.range(3), "other")
    with scratch(spark):
        inside = materialize(spark.range(5), "inside")
        folder = inside.inputFiles()[0].removeprefix("file:").replace("//", "/").rsplit("/", 1)[0]
        inside.write.parquet(str(tmp_path / "out"))
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)
    assert other.count() == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_an_appended_log_has_files_by_days_and_tasks_not_by_their_product(spark, tmp_path):
    days, tasks = 200, 8
    rows = spark.range(0, 24 * days, 1, tasks).select(  # every task has rows of every day
        F.pmod(F.col("id") * 7919, F.lit(24 * days)).alias("id"), F.lit("q").alias("query"), F.lit("a").alias("response"),
        F.lit("f").alias("context_file"))
    rows = rows.withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(id), 0, 0)"))
    root = str(tmp_path / "log")
    IO.append_chat(rows, root)
    files = [f for _, _, names in os.walk(f"{root}/chat_history") for f in names if f.endswith(".parquet")]
    assert days <= len(files) <= days + tasks
    back = spark.read.parquet(f"{root}/chat_history")
    assert sorted(back.drop("day").collect()) == sorted(rows.collect())
    assert back.where("day <> to_date(timestamp)").count() == 0


def test_rows_of_one_time_are_not_written_by_one_task(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 4).select("id", F.sha2(F.col("id").cast("string"), 512).alias("query"), F.lit("a").alias("response"),
                                                F.lit("f").alias("context_file"), F.expr("timestamp_ntz'2024-01-01'").alias("timestamp"))
    IO.append_chat(rows, str(tmp_path))
    files = [f for _, _, names in os.walk(f"{tmp_path}/chat_history") for f in names if f.endswith(".parquet")]
    assert len(files) > 1 and spark.read.parquet(f"{tmp_path}/chat_history").count() == 40_000
