"""A run is in the history whole or not at all; a tree of files likewise."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from liveness.operators.joins import entities_for_session
from liveness.operators.rollups import project_summary
from liveness.sources import history as H
from liveness.sources.files import scan_files, write_tree

AT = datetime(2024, 5, 6, 7, 8, 9, 123456)


def _results(spark, n=6):
    return spark.range(n).select(
        F.concat(F.lit("src/f"), (F.col("id") % 2).cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("fn_"), F.col("id").cast("string")).alias("name"), F.lit("function").alias("entity_type"),
        F.col("id").cast("int").alias("start_line"), (F.col("id") + 3).cast("int").alias("end_line"),
        F.lit(0.6).alias("confidence"), F.lit("why").alias("explanation"), F.lit(2).cast("long").alias("call_count"),
        F.lit(1).alias("is_exported"), F.lit(0).alias("used_in_tests"), F.lit(0).alias("dynamic_call_risk"),
        F.lit(3).alias("cyclomatic_complexity"), F.lit(1).alias("file_depth"))


def _seen(spark, root):
    h = {n: H.history_table(spark, root, n) for n in H.TABLES}
    entities = entities_for_session(h["code_entities"], h["explanations"], h["feature_vectors"]).count()
    summary = {r.project_path: (r.total_sessions, r.total_entities)
               for r in project_summary(h["analysis_sessions"], h["code_entities"]).collect()}
    return entities, summary


def test_a_run_that_dies_between_its_tables_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "history")
    assert _seen(spark, root) == (0, {})
    write, calls = H._write, []

    def dies(rows, at, name, run):
        calls.append(name)
        if len(calls) == 3:
            raise RuntimeError("killed")
        write(rows, at, name, run)

    monkeypatch.setattr(H, "_write", dies)
    with pytest.raises(RuntimeError):
        H.append_analysis(_results(spark), root, "p", run_time=AT)
    assert os.path.isdir(os.path.join(root, "code_entities"))  # two tables are written, none is seen
    assert _seen(spark, root) == (0, {})
    monkeypatch.setattr(H, "_write", write)
    other = H.append_analysis(_results(spark, 4), root, "q", run_time=AT)
    assert _seen(spark, root) == (4, {"q": (1, 4)})
    # the retry replaces what the first try left
    session = H.append_analysis(_results(spark), root, "p", run_time=AT)
    assert _seen(spark, root) == (10, {"p": (1, 6), "q": (1, 4)})
    assert session != other and session == H.run_of("p", AT)[1]
    log = {r.project: r for r in H.committed_runs(spark, root).collect()}
    assert log["p"].session_id == session and log["p"].run_time == AT


def test_a_committed_run_is_not_written_again(spark, tmp_path):
    root = str(tmp_path / "history")
    first = H.append_analysis(_results(spark), root, "p", run_time=AT)
    assert H.append_analysis(_results(spark), root, "p", run_time=AT) == first
    assert _seen(spark, root) == (6, {"p": (1, 6)})
    H.append_analysis(_results(spark), root, "p", run_time=AT + timedelta(days=1))
    assert _seen(spark, root) == (12, {"p": (2, 12)})


def test_a_half_written_manifest_is_no_commit(spark, tmp_path):
    root = str(tmp_path / "history")
    H.append_analysis(_results(spark), root, "p", run_time=AT)
    with open(os.path.join(root, "commits", "r123.json"), "w") as f:
        f.write('{"run": "r123", "sess')
    assert H.committed_runs(spark, root).count() == 1
    assert _seen(spark, root) == (6, {"p": (1, 6)})


def test_abandoned_runs_are_deleted_and_committed_ones_stay(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "history")
    H.append_analysis(_results(spark), root, "p", run_time=AT)
    monkeypatch.setattr(H, "put_if_absent", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        H.append_analysis(_results(spark), root, "q", run_time=AT)
    assert H.drop_abandoned(spark, root, datetime(2000, 1, 1)) == 0  # too young
    assert H.drop_abandoned(spark, root, datetime(2100, 1, 1)) == len(H.TABLES)
    assert _seen(spark, root) == (6, {"p": (1, 6)})


def _files(spark, *rows):
    return spark.createDataFrame(rows, "rel_path string, content string")


def test_every_row_of_a_tree_is_a_file(spark, tmp_path):
    root = str(tmp_path / "tree")
    rows = [(f"d{i % 7}/e {i % 3}/ü{i}.py", f"x = {i}" + "\n" * (i % 2)) for i in range(200)] + [("a.py", None), ("b/.hid=den.py", "")]
    assert write_tree(_files(spark, *rows).repartition(9), root) == 202
    got = {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names
           if not f.endswith(".crc")}
    assert got == {p: (c or "").rstrip("\n") + "\n" for p, c in rows}
    assert [p for p in os.listdir(tmp_path)] == ["tree"]
    scanned = {r.rel_path for r in scan_files(spark, root).collect()}
    assert scanned == {p for p, _ in rows if not p.startswith("b/.")}  # Spark's listing leaves out names with a leading dot


def test_a_repeated_path_is_an_error_and_leaves_no_tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    with pytest.raises(ValueError, match="a/x.py"):
        write_tree(_files(spark, ("a/x.py", "one"), ("a/x.py", "two"), ("a/y.py", "three")), root)
    assert not os.path.exists(root)


@pytest.mark.parametrize("path", [None, "", "/etc/x.py", "../x.py", "a/../../x.py", "a//b.py", "./a.py", "a/"])
def test_paths_outside_the_tree_are_errors(spark, tmp_path, path):
    with pytest.raises(ValueError):
        write_tree(_files(spark, (path, "x"), ("ok.py", "y")), str(tmp_path / "tree"))
    assert os.listdir(tmp_path) == []


def test_a_failing_task_leaves_no_tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    with pytest.raises(Exception):  # noqa: B017 - a file where another path needs a folder
        write_tree(_files(spark, ("a", "file"), ("a/b.py", "x")).coalesce(1), root)
    assert os.listdir(tmp_path) == []
    write_tree(_files(spark, ("a.py", "x")), root)
    with pytest.raises(FileExistsError):
        write_tree(_files(spark, ("b.py", "x")), root)


def test_a_run_over_the_corpus_derives_it_once_and_writes_no_copy_of_its_rows(spark, monkeypatch):
    from liveness.plans import q_corpus, q_io
    small, made, copies, files, copy = "/root/testdata/sf0.001", [], [], q_io.corpus_files, H.materialize
    for module in (q_io, q_corpus):
        monkeypatch.setattr(module, "corpus_files", lambda s, d: made.append(d) or files(s, d))
    monkeypatch.setattr(H, "materialize", lambda df, name: copies.append(name) or copy(df, name))
    tables, session = q_io._history(spark, small)
    assert (len(made), copies) == (1, [])
    row = tables["analysis_sessions"].first()
    assert row.id == session and row.total_files == files(spark, small).count()  # files that do not parse count
    ids = [sorted(r[0] for r in tables[n].select(c).collect())
           for n, c in (("code_entities", "id"), ("feature_vectors", "entity_id"), ("explanations", "entity_id"))]
    assert ids[0] == ids[1] == ids[2] and len(set(ids[0])) == len(ids[0]) > 0


def test_staged_results_are_stored_as_others_and_stay(spark, tmp_path):
    from liveness.session import materialize
    rows = materialize(_results(spark), "given")
    for root, staged in (("a", False), ("b", True)):
        H.append_analysis(rows, str(tmp_path / root), "p", run_time=AT, staged=staged)
    for name in H.TABLES:
        a, b = (sorted(map(str, H.history_table(spark, str(tmp_path / root), name).collect())) for root in "ab")
        assert a == b and a
    assert rows.count() == 6
