"""Checked queries over the history tables (sessions, entities, explanations,
feature vectors, removals, chat)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import joins, ordering, rollups
from . import views as V
from .registry import query, snap_sql

W = V.with_views


@query("recent_sessions", W(f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY "timestamp" DESC, id DESC) AS rank
  FROM sessions) WHERE rank <= {K.RECENT_SESSIONS}""", "sessions"))
def q_recent_sessions(spark, d):
    return ordering.recent_sessions(V.sessions(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("project_summary", W(f"""WITH owned AS (
  SELECT project_path, confidence_score AS c FROM sessions JOIN code_entities ON sessions.id = code_entities.session_id),
runs AS (SELECT project_path, count(*) AS total_sessions FROM sessions GROUP BY project_path),
bands AS (SELECT project_path, count(*) AS total_entities, avg(c) AS mean,
  count(*) FILTER (c >= 0.75) AS danger_count, count(*) FILTER (c >= 0.55 AND c < 0.75) AS warning_count,
  count(*) FILTER (c >= 0.35 AND c < 0.55) AS review_count, count(*) FILTER (c < 0.35) AS safe_count
  FROM owned GROUP BY project_path)
SELECT project_path, total_sessions, {', '.join(f"COALESCE({n}, 0) AS {n}" for n in (
    "total_entities", "danger_count", "warning_count", "review_count", "safe_count"))},
  {snap_sql("COALESCE(mean, 0.0)")} AS avg_confidence
FROM runs LEFT JOIN bands USING (project_path)""", "sessions", "code_entities"))
def q_project_summary(spark, d):
    return rollups.project_summary(V.sessions(spark, d), V.code_entities(spark, d))


@query("session_entity_join", W("""
SELECT ce.*, a.project_path, a."timestamp" AS session_timestamp
FROM code_entities ce JOIN sessions a ON a.id = ce.session_id""", "sessions", "code_entities"))
def q_session_entity_join(spark, d):
    return joins.session_entity_join(V.code_entities(spark, d), V.sessions(spark, d))


@query("entities_for_session", W("""WITH said AS (
  SELECT entity_id AS said_of, summary AS explanation_summary, risk_level, confidence_explanation, llm_reasoning,
    recommendation, action, xai_json,
    CASE WHEN json_valid(xai_json) THEN json_extract_string(xai_json, '$.summary') END AS xai_summary FROM explanations),
measured AS (SELECT * EXCLUDE (id) RENAME (entity_id AS measured_of) FROM feature_vectors)
SELECT * EXCLUDE (said_of, measured_of) FROM code_entities
LEFT JOIN said ON code_entities.id = said_of LEFT JOIN measured ON code_entities.id = measured_of""",
                                       "code_entities", "explanations", "feature_vectors"))
def q_entities_for_session(spark, d):
    out = joins.entities_for_session(V.code_entities(spark, d), V.explanations(spark, d),
                                     V.feature_vectors(spark, d))
    return (out.withColumn("xai_summary", F.try_variant_get("xai_explanation", "$.summary", "string"))
            .drop("xai_explanation"))


@query("parse_xai_json", W("""
SELECT id, entity_id,
  CASE WHEN json_valid(xai_json) THEN json_extract_string(xai_json, '$.summary') END AS xai_summary,
  CASE WHEN json_valid(xai_json) THEN json_extract_string(xai_json, '$.risk_level') END AS xai_risk_level,
  json_valid(xai_json) AS xai_valid
FROM explanations""", "explanations"))
def q_parse_xai_json(spark, d):
    from ..functions.jsonx import parse_xai_json
    e = V.explanations(spark, d).withColumn("_x", parse_xai_json("xai_json"))
    return e.select("id", "entity_id", F.col("_x.summary").alias("xai_summary"),
                    F.col("_x.risk_level").alias("xai_risk_level"),
                    F.col("_x").isNotNull().alias("xai_valid"))


@query("recent_removals", W(f"""
SELECT * FROM removal_logs ORDER BY "timestamp" DESC, id DESC LIMIT {K.RECENT_REMOVALS}""", "removal_logs"))
def q_recent_removals(spark, d):
    return ordering.recent_removals(V.removal_logs(spark, d))


@query("recent_chat", W(f"""
SELECT * FROM chat_history ORDER BY "timestamp" DESC, id DESC LIMIT {K.RECENT_CHATS}""", "chat_history"))
def q_recent_chat(spark, d):
    return ordering.recent_chat(V.chat_history(spark, d))


@query("latest_result_per_file", """
SELECT * FROM (
  SELECT 'src/u' || CAST(user_id AS VARCHAR) || '.py' AS file_name, event_id, ts AS analyzed_at, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""")
def q_latest_result_per_file(spark, d):
    from ..session import table
    ev = table(spark, d, "events").select(
        F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("file_name"),
        "event_id", F.col("ts").alias("analyzed_at"), "value")
    out = ordering.latest_per_key(ev, ["file_name"], ["analyzed_at", "event_id"])
    return out.withColumn("rn", F.lit(1).cast("long"))
