"""Boundary values for bands, percents, reasons; the reference's own ETL cases; line
removal; question routing."""

import pytest
from pyspark.sql import functions as F

from liveness.functions import clean as C
from liveness.functions import scores as S
from liveness.functions import text as T
from liveness.operators import questions as QU
from liveness.operators import source_text as ST


def test_bands_and_percents(spark):
    rows = [(1, 0.35), (2, 0.55), (3, 0.75), (4, 0.5), (5, 0.15), (6, 0.3), (7, 0.74996), (8, None),
            (9, 0.29)]
    df = spark.createDataFrame(rows, "id int, c double")
    out = {r.id: r for r in df.select(
        "id", S.severity_band("c").alias("band"), S.percent_trunc("c").alias("t"),
        S.percent_round("c").alias("r"), S.percent_alive("c").alias("a"),
        S.severity_band(S.round_half_up("c", 4)).alias("stored_band"),
        S.predicted_dead("c").alias("dead")).collect()}
    assert [out[i].band for i in (1, 2, 3, 5, 6)] == ["review", "warning", "danger", "safe", "safe"]
    # banded on the unrounded value, re-banded from the stored rounded one
    assert out[7].band == "warning" and out[7].stored_band == "danger"
    assert out[8].band is None
    assert out[4].dead is False
    # truncation vs half-up
    assert (out[9].t, out[9].r) == (28, 29)
    assert out[1].a == 65


def test_reasons_and_texts(spark):
    df = spark.createDataFrame(
        [("_old_temp", 0, 0, 0, 0, 1, 7, 0.8)],
        "name string, call_count long, is_exported int, used_in_tests int, dynamic_call_risk int, "
        "cyclomatic_complexity int, file_depth int, confidence double")
    r = df.select(T.reasons_dead("name").alias("d"), T.reasons_alive().alias("a"),
                  T.summary_text("name", "confidence").alias("s"),
                  T.explanation_text("name", "confidence").alias("e")).first()
    assert len(r.d) == 8 and r.a == []
    assert "'old'" in r.d[6]          # first marker in list order, not position
    assert r.s == "danger 80/100 _old_temp -> remove" and r.e.endswith("[score 80 of 100]")


def test_reference_etl_cases(spark):
    # mock CSV rows and the single-record case
    raw = spark.createDataFrame([("1", "100", "ACTIVE"), ("2", "BAD_DATA", "pending"), ("3", "300", "CLOSED"),
                                 ("5", "500", " pending "), ("6", "N/A", "NULL"), ("7", "", "x")],
                                "id string, value string, status string")
    out = {r.id: r for r in C.clean_records(raw).collect()}
    assert [out[i].value for i in ("1", "2", "3", "5")] == [100, -1, 300, 500]
    assert out["5"].status == "PENDING" and out["2"].status == "PENDING"
    assert out["6"].value is None and out["6"].status is None and out["7"].value is None
    # integers are clamped, digit strings are not
    ints = spark.createDataFrame([("a", -1), ("b", 1001), ("c", 5)], "id string, value int")
    assert [r.value for r in C.clean_records(ints).orderBy("id").collect()] == [0, 1000, 5]
    assert C.clean_records(spark.createDataFrame([("d", "5000")], "id string, value string")).first().value == 5000


def test_formula(spark):
    df = spark.createDataFrame([(10, 5), (1, 0)], "x long, y long")
    out = C.evaluate_formula(df, "x * y + 2", {"x": "x", "y": "y"}).collect()
    assert out[0].result == 52
    div = C.evaluate_formula(df, "x / y", {"x": "x", "y": "y"}).collect()
    assert div[1].result is None
    for bad in ("__import__('os')", "x.real", "z + 1"):
        try:
            C.formula_column(bad, {"x": F.col("x")})
        except ValueError:
            pass
        else:
            raise AssertionError(bad)


def test_remove_line_ranges(spark):
    files = spark.createDataFrame([("a.py", "l1\nl2\nl3\nl4\nl5\nl6"), ("b.py", "x1\nx2\n")],
                                  "path string, content string")
    ranges = spark.createDataFrame([("a.py", 2, 3), ("a.py", 3, 4), ("a.py", 6, 9), ("b.py", 1, 1)],
                                   "path string, start_line int, end_line int")
    exact = {r.path: r for r in ST.remove_line_ranges(files, ranges).collect()}
    assert exact["a.py"].new_content == "l1\nl5" and exact["a.py"].removed_lines == 4
    assert exact["b.py"].new_content == "x2\n"
    editor = {r.path: r for r in ST.remove_line_ranges(files, ranges, extra_lines=1).collect()}
    # the deletion reaches the end: the newline before it stays
    assert editor["a.py"].new_content == "l1\n" and editor["b.py"].new_content == ""
    eof = spark.createDataFrame([("c.py", "a\nb\nx"), ("d.py", "a\nb\nx\n"), ("e.py", "a\nb")],
                                "path string, content string")
    er = spark.createDataFrame([("c.py", 3, 3), ("d.py", 3, 3), ("e.py", 1, 1)],
                               "path string, start_line int, end_line int")
    got = {r.path: r.new_content for r in ST.remove_line_ranges(eof, er, extra_lines=1).collect()}
    assert got == {"c.py": "a\nb\n", "d.py": "a\nb\n", "e.py": ""}
    logs_ed = ST.removal_rows(eof, er.withColumn("confidence", F.lit(0.9)), extra_lines=1).collect()
    assert {r.file_name: r.removed_code for r in logs_ed} == {"c.py": "x", "d.py": "x\n", "e.py": "a\nb"}
    logs = ST.removal_rows(files, ranges.withColumn("confidence", F.lit(0.8))).collect()
    assert sorted(r.removed_code for r in logs if r.file_name == "a.py") == ["l2\nl3", "l3\nl4", "l6"]


def test_question_routing(spark):
    qs = [("how many dead ones?", "count"), ("why is foo safe to remove", "removable"),
          ("Explain foo", "explain"), ("overview please", "summary"), ("HELP", "help"),
          ("what is dead code", "definition"), ("hello", "unknown"), ("how many files", "unknown")]
    df = spark.createDataFrame(qs, "q string, expected string")
    for r in df.select(QU.classify_questions("q").alias("got"), "expected").collect():
        assert r.got == r.expected


def test_symbol_named_in_text_matches_substrings(spark):
    from liveness.operators.joins import symbol_named_in_text
    q = spark.createDataFrame([(1, "f", "please explain GET_user now"), (2, "f", "nothing here"),
                               (3, "g", "why get")], "question_id int, file_name string, text string")
    s = spark.createDataFrame([("f", 2, "get_user"), ("f", 1, "get"), ("f", 3, "xyz"), ("g", 4, "et")],
                              "file_name string, entity_id int, name string")
    out = {r.question_id: r.sym_name for r in symbol_named_in_text(q, s).collect()}
    assert out == {1: "get", 2: None, 3: "et"}


def test_digit_strings_edges(spark):
    rows = [("a", "12\n"), ("b", "9" * 38), ("c", "9" * 39), ("d", "0" * 50 + "7"), ("e", "99999999999999999999"), ("f", "\n12")]
    out = {r.id: (r.value, r.value_quarantine) for r in
           C.clean_records(spark.createDataFrame(rows, "id string, value string")).collect()}
    assert out == {"a": (-1, None), "b": (int("9" * 38), None), "c": (None, "9" * 39), "d": (7, None),
                   "e": (99999999999999999999, None), "f": (-1, None)}


def test_formula_edges(spark):
    df = spark.createDataFrame([(7, 2, 0), (-7, 2, 0), (2 ** 62 + 1, 3, 0)], "x long, y long, z long")
    get = lambda f: [r.result for r in C.evaluate_formula(df, f, {"x": "x", "y": "y", "z": "z"}).collect()]
    assert get("x // y") == [3, -4, (2 ** 62 + 1) // 3]
    assert get("x % y") == [1, 1, (2 ** 62 + 1) % 3]
    assert get("x % (0 - y)")[:2] == [-1, -1]
    assert get("x // z") == get("x % z") == get("x / z") == get("z ** (0 - y)") == [None] * 3


def test_canonical_json_ignores_field_order(spark):
    from liveness.functions import text as T
    df = spark.createDataFrame([(1, "a\"b")], "n int, s string")
    a = df.select(F.struct("n", "s").alias("x"))
    b = df.select(F.struct("s", "n").alias("x"))
    ja, jb = (d.select(T.canonical_json(d, "x").alias("j")).first().j for d in (a, b))
    assert ja == jb == '{"n": 1, "s": "a\\"b"}'


def test_stage_folder_is_required_on_a_cluster():
    from liveness import session as S

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Context:
        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.stage_root(Session())


def test_a_million_ranges_of_one_file_merge_like_the_definition(spark):
    from liveness.operators import source_text as ST
    import random
    rnd = random.Random(9)
    n = 3000
    ranges = [("f", s, s + rnd.choice([0, 0, 1, 2, 40, -1])) for s in (rnd.randint(-3, n + 5) for _ in range(1500))] + [("g", None, 2), ("g", 5, None)]
    files = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(1, n + 1))), ("g", "a\nb\nc\nd\ne\nf"), ("h", None)], "path string, content string")
    df = spark.createDataFrame(ranges, "path string, start_line int, end_line int")
    for extra in (0, 1):
        gone = {x for _, s, e in ranges[:1500] for x in range(max(s, 1), min(e + extra, n) + 1)}
        stretches = ST.merged_ranges(df.where("path = 'f'"), extra_lines=extra, block=64).orderBy("s").collect()
        assert {x for r in stretches for x in range(r.s, min(r.e, n) + 1) if x <= n} == gone
        assert all(a.e + 1 < b.s for a, b in zip(stretches, stretches[1:]))
        got = {r.path: r for r in ST.remove_line_ranges(files, df, extra_lines=extra).collect()}
        assert got["f"].new_content.rstrip("\n").split("\n") == [f"l{i}" for i in range(1, n + 1) if i not in gone]
        assert got["f"].removed_lines == len(gone)
    assert ST.remove_line_ranges(files, df).where("path = 'g'").first().new_content == "c\nd"
    # a million ranges: every second line of two million
    import time
    big = spark.createDataFrame([("f", "\n".join(map(str, range(2_000_000))))], "path string, content string")
    many = spark.range(1_000_000).select(F.lit("f").alias("path"), (F.col("id") * 2 + 1).alias("start_line"), (F.col("id") * 2 + 1).alias("end_line"))
    began = time.time()
    row = ST.remove_line_ranges(big, many).select("removed_lines", F.substring("new_content", 1, 7).alias("head")).first()
    assert row.removed_lines == 1_000_000 and row.head == "1\n3\n5\n7"
    assert time.time() - began < 60
