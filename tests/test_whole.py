"""Queries whose rows must be whole: every column of the analysis, every item of every answer; positions without stages."""

import pytest
from pyspark.sql import functions as F

from liveness.operators import extract as X
from liveness.operators import ordering as O
from liveness.plans.registry import QUERIES, load_all

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def queries():
    load_all()
    return QUERIES


def test_the_analysis_returns_scores_and_texts(spark, queries):
    columns = set(queries["analyze_corpus"](spark, D).columns)
    assert {"confidence", "severity", "reasons_dead", "reasons_alive", "summary", "explanation", "top_features", "snippet"} <= columns


def test_every_question_has_all_items_of_its_answer(spark, queries):
    rows = queries["answer_questions"](spark, D)
    per = rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_items").alias("items"), F.max("item_no").alias("last")).collect()
    asked = spark.read.parquet(f"{D}/conversations.parquet").where("role = 'user'").count()
    assert len(per) == asked and all(r.question_id is not None and r.n == r["items"] + 1 and r["last"] == r["items"] for r in per)


def test_positions_of_small_groups_move_rows_once_and_write_none(spark, monkeypatch):
    import liveness.session as S
    wrote = []
    monkeypatch.setattr(S, "materialize", lambda df, name: wrote.append(name) or df)
    rows = spark.range(20_000).select((F.col("id") % 4001).alias("file_name"), F.col("id").alias("entity_id"),
                                      F.hash("id").alias("name"), F.hash("id").alias("start_line"))
    out = O.sort_results(O.sort_results(rows, mode="name").withColumnRenamed("sort_pos", "n"), mode="line")
    assert wrote == []
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert out.where("n <> sort_pos").count() == 0 and out.count() == 20_000


def test_positions_of_large_null_and_small_groups(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("f"), F.col("id") % 997))
    rows = spark.range(30_000).select(key.alias("g"), F.col("id"))
    got = O.positions_within(rows, "g", [F.col("id").desc()]).collect()
    groups: dict = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append(r.id)
    want = {(g, i): n for g, ids in groups.items() for n, i in enumerate(sorted(ids, reverse=True), 1)}
    assert {(r.g, r.id): r.pos for r in got} == want and len(got) == 30_000


def test_only_the_kinds_asked_for_leave_the_pass():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"p": ["a.py", "b.py"], "c": ["def f(x):\n    return g('é', h(x))\n", "def (:\n"]})
    rows = lambda kinds: [r for b in X._extract_batches(iter([batch]), "p", "c", frozenset(kinds)) for r in b.to_pylist()]
    by_kind = lambda rows: sorted((r["kind"], r["path"], r["name"] or r["callee"]) for r in rows)
    every = rows(("entity", "call", "error"))
    assert by_kind(every) == [("call", "a.py", "g"), ("call", "a.py", "h"), ("entity", "a.py", "f"), ("error", "b.py", None)]
    for kind in ("entity", "call", "error"):
        assert rows((kind,)) == [r for r in every if r["kind"] == kind]
    assert [r["snippet"] for r in every if r["kind"] == "entity"] == ["def f(x):\n    return g('é', h(x))"]
