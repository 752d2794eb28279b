"""Sources, sinks and the record pipeline: write through the shared stage folder, read
back, and return what was read (the oracle is the source rows themselves)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import clean as C
from ..operators import extract as X
from ..operators.joins import entities_for_session
from ..operators.ordering import recent_chat, recent_removals
from ..operators.rollups import project_summary
from ..session import materialize, new_stage_path
from ..sources import history as H
from ..sources import io as IO
from . import views as V
from .corpus import corpus_files
from .q_etl import CLEAN_SQL
from .registry import query, snap_sql

W = V.with_views


def run_pipeline(spark, src_path: str, out_path: str) -> bool:
    """read CSV records -> clean -> write; True when something was written. Lazy until
    the sink."""
    raw = IO.read_records_csv(spark, src_path)
    return IO.write_table_if_any(C.clean_records(raw), out_path)


def _records_csv(spark, d):
    raw = V.raw_records(spark, d).select("id", "value", "status")
    path = new_stage_path(spark, "records-csv")
    IO.write_records_csv(raw, path)
    return path


@query("read_records_csv", W("SELECT id, value, status FROM raw_records", "raw_records"))
def q_read_records_csv(spark, d):
    return IO.read_records_csv(spark, _records_csv(spark, d))


@query("run_pipeline", W(f"SELECT id, value, value_quarantine, status FROM ({CLEAN_SQL})", "raw_records"))
def q_run_pipeline(spark, d):
    out = new_stage_path(spark, "pipeline-out")
    ok = run_pipeline(spark, _records_csv(spark, d), out)
    return spark.read.parquet(out) if ok else spark.createDataFrame([], "id string, value decimal(38,0), value_quarantine string, status string")


@query("read_json_map", W("SELECT CAST(user_id AS VARCHAR) AS id, name, email, active FROM users", "users"))
def q_read_json_map(spark, d):
    path = new_stage_path(spark, "users-json")
    IO.write_json_map(V.users(spark, d), path, key="user_id", drop=("nation",))
    return IO.read_json_map(spark, path, "name:string,email:string,active:boolean")


@query("write_table_if_any", W("SELECT * FROM cat_features", "cat_features"))
def q_write_table_if_any(spark, d):
    from .q_catalogue import features
    path = new_stage_path(spark, "table")
    ok = IO.write_table_if_any(features(spark, d), path)
    empty_ok = IO.write_table_if_any(features(spark, d).where(F.lit(False)), new_stage_path(spark, "empty"))
    assert ok and not empty_ok
    return spark.read.parquet(path)


@query("write_training_csv", W("SELECT entity_id, call_count, is_exported, used_in_tests, dynamic_call_risk, "
                               "cyclomatic_complexity, file_depth FROM cat_features", "cat_features"))
def q_write_training_csv(spark, d):
    from .q_catalogue import features
    path = new_stage_path(spark, "training-csv")
    cols = ["entity_id", "call_count", "is_exported", "used_in_tests", "dynamic_call_risk",
            "cyclomatic_complexity", "file_depth"]
    IO.write_training_csv(features(spark, d).select(*cols), path)
    schema = ("entity_id bigint, call_count bigint, is_exported int, used_in_tests int, dynamic_call_risk int, "
              "cyclomatic_complexity int, file_depth int")
    return spark.read.option("header", True).schema(schema).csv(path)


@query("emit_results_json", W("""SELECT 1 AS session_id, id AS entity_id, file_name, confidence_score, start_line,
  CASE WHEN confidence_score >= 0.5 THEN ['high', entity_name] ELSE [] END AS reasons,
  entity_type AS kind, CASE WHEN end_line % 2 = 0 THEN NULL ELSE end_line END AS end_line FROM code_entities""", "code_entities"))
def q_emit_results_json(spark, d):
    """Nested results (a list, a struct, nulls) through the JSON sink and back."""
    path = new_stage_path(spark, "results-json")
    res = V.code_entities(spark, d).select(
        F.col("id").alias("entity_id"), "file_name", "confidence_score",
        F.when(F.col("confidence_score") >= 0.5, F.array(F.lit("high"), F.col("entity_name")))
        .otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.struct(F.col("entity_type").alias("kind"), F.col("start_line"),
                 F.when(F.col("end_line") % 2 != 0, F.col("end_line")).alias("end_line")).alias("symbol"))
    IO.emit_results_json(res, path, session_id=1)
    back = spark.read.text(path).select(F.from_json(
        "value", "session_id int, result struct<entity_id:bigint,file_name:string,confidence_score:double,"
                 "reasons:array<string>,symbol:struct<kind:string,start_line:int,end_line:int>>").alias("j"))
    return back.select("j.session_id", "j.result.*").select("session_id", "entity_id", "file_name", "confidence_score", "reasons", "symbol.*")


def _append_chat(spark, d):
    root = new_stage_path(spark, "history")
    IO.append_chat(V.chat_history(spark, d), root)
    return spark.read.parquet(f"{root}/chat_history")


def _append_removals(spark, d):
    root = new_stage_path(spark, "history")
    IO.append_removals(V.removal_logs(spark, d), root)
    return spark.read.parquet(f"{root}/removal_logs")


@query("append_chat", W('SELECT id, query, response, context_file, "timestamp" FROM chat_history', "chat_history"))
def q_append_chat(spark, d):
    """Append all questions with their answers: every row, with its id and time."""
    return _append_chat(spark, d).select("id", "query", "response", "context_file", "timestamp")


@query("append_removals", W('SELECT id, entity_id, file_name, removed_code, confidence_score, "timestamp" FROM removal_logs',
                            "removal_logs"))
def q_append_removals(spark, d):
    return _append_removals(spark, d).select("id", "entity_id", "file_name", "removed_code", "confidence_score", "timestamp")


@query("append_chat_recent", W(f"""SELECT query, response, context_file, "timestamp" FROM chat_history
ORDER BY "timestamp" DESC, id DESC LIMIT {K.RECENT_CHATS}""", "chat_history"))
def q_append_chat_recent(spark, d):
    """The newest of the appended rows, through the history query."""
    return recent_chat(_append_chat(spark, d)).select("query", "response", "context_file", "timestamp")


@query("append_removals_recent", W(f"""SELECT entity_id, file_name, removed_code, confidence_score, "timestamp" FROM removal_logs
ORDER BY "timestamp" DESC, id DESC LIMIT {K.RECENT_REMOVALS}""", "removal_logs"))
def q_append_removals_recent(spark, d):
    return recent_removals(_append_removals(spark, d)).select(
        "entity_id", "file_name", "removed_code", "confidence_score", "timestamp")


def _history(spark, d):
    """The history tables after one run over the corpus, and its session id. The files are counted as they are
    parsed; snippets are not stored."""
    from .analyze import analyze_corpus
    seen = Observation("files")
    files = corpus_files(spark, d).select("rel_path", "content").observe(seen, F.count(F.lit(1)).alias("n"))
    extracted = materialize(X.extract(files).drop("snippet"), "extract")
    results, _ = analyze_corpus(None, extracted=extracted)
    root = new_stage_path(spark, "history")
    session = H.append_analysis(results, root, project="corpus", total_files=seen.get.get("n", 0), staged=True)
    return {n: H.history_table(spark, root, n) for n in H.TABLES}, session


def _appended_sql(body: str) -> str:
    from .q_corpus import _analyze_sql
    return body.format(run="(" + _analyze_sql() + ")")


@query("append_analysis", _appended_sql("""SELECT path AS file_name, name AS entity_name, entity_type, start_line, end_line,
  confidence AS confidence_score, explanation AS explanation_summary, '' AS risk_level, call_count, is_exported, used_in_tests,
  CAST(dynamic_call_risk AS DOUBLE) AS dynamic_call_risk, cyclomatic_complexity, file_depth, explanation AS xai_summary
FROM {run}"""))
def q_append_analysis(spark, d):
    """Persist a run, then read its session back through the history join: the four tables link."""
    h, session = _history(spark, d)
    back = entities_for_session(h["code_entities"], h["explanations"], h["feature_vectors"], session_id=session)
    return back.select("file_name", "entity_name", "entity_type", "start_line", "end_line", "confidence_score",
                       "explanation_summary", "risk_level", "call_count", "is_exported", "used_in_tests", "dynamic_call_risk",
                       "cyclomatic_complexity", "file_depth",
                       F.try_variant_get("xai_explanation", "$.summary", "string").alias("xai_summary"))


@query("project_summary_of_run", _appended_sql(f"""SELECT 'corpus' AS project_path, CAST(1 AS BIGINT) AS total_sessions,
  count(*) AS total_entities, {snap_sql('avg(confidence)')} AS avg_confidence,
  CAST(count(*) FILTER (confidence >= 0.75) AS BIGINT) AS danger_count,
  CAST(count(*) FILTER (confidence >= 0.55 AND confidence < 0.75) AS BIGINT) AS warning_count,
  CAST(count(*) FILTER (confidence >= 0.35 AND confidence < 0.55) AS BIGINT) AS review_count,
  CAST(count(*) FILTER (confidence < 0.35) AS BIGINT) AS safe_count,
  (SELECT CAST(count(DISTINCT l_orderkey) AS INTEGER) FROM lineitem) AS total_files FROM {{run}}
UNION ALL SELECT 'never analysed', 0, 0, 0.0, 0, 0, 0, 0, 0"""))
def q_project_summary_of_run(spark, d):
    """Summaries of the project just persisted and of one without sessions (a row of zeros)."""
    h, _ = _history(spark, d)
    one = lambda p: project_summary(h["analysis_sessions"], h["code_entities"], project=p)
    files = lambda p: h["analysis_sessions"].where(F.col("project_path") == p).agg(
        F.coalesce(F.sum("total_files"), F.lit(0)).cast("int").alias("total_files"))
    return reduce(DataFrame.unionByName, [one(p).crossJoin(files(p)) for p in ("corpus", "never analysed")])  # one row each
