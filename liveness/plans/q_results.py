"""Checked queries over scored results (one symbol per line item, file = supplier)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores as S
from ..functions import text as T
from ..operators import joins, ordering, rollups
from ..session import table
from . import views as V
from .registry import query

W = V.with_views

SEVERITY_SQL = """CASE WHEN {c} IS NULL THEN NULL WHEN {c} >= 0.75 THEN 'danger' WHEN {c} >= 0.55 THEN 'warning'
  WHEN {c} >= 0.35 THEN 'review' ELSE 'safe' END"""


def sev(c: str) -> str:
    return SEVERITY_SQL.format(c=c)


COUNTS_SQL = f"""SELECT file_name, count(*) AS total_symbols,
  CAST(sum(CASE WHEN {sev('confidence')} = 'danger' THEN 1 ELSE 0 END) AS BIGINT) AS danger_count,
  CAST(sum(CASE WHEN {sev('confidence')} = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warning_count,
  CAST(sum(CASE WHEN {sev('confidence')} = 'review' THEN 1 ELSE 0 END) AS BIGINT) AS review_count,
  CAST(sum(CASE WHEN {sev('confidence')} = 'safe' THEN 1 ELSE 0 END) AS BIGINT) AS safe_count
FROM scored_results GROUP BY file_name"""


def _results(spark, d):
    return V.scored_results(spark, d)


def _counts(spark, d):
    return rollups.severity_counts(_results(spark, d))


@query("severity_band", W(f"SELECT entity_id, confidence, {sev('confidence')} AS severity FROM scored_results",
                          "scored_results"))
def q_severity_band(spark, d):
    return _results(spark, d).select("entity_id", "confidence", S.severity_band("confidence").alias("severity"))


@query("percent_trunc", W("""SELECT entity_id, CAST(trunc(confidence * 100) AS INTEGER) AS pct
FROM scored_results""", "scored_results"))
def q_percent_trunc(spark, d):
    return _results(spark, d).select("entity_id", S.percent_trunc("confidence").alias("pct"))


@query("percent_round", W("""SELECT entity_id, CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS pct
FROM scored_results""", "scored_results"))
def q_percent_round(spark, d):
    return _results(spark, d).select("entity_id", S.percent_round("confidence").alias("pct"))


@query("percent_alive", W("""SELECT entity_id, CAST(floor((1.0 - confidence) * 100 + 0.5) AS INTEGER) AS pct
FROM scored_results""", "scored_results"))
def q_percent_alive(spark, d):
    return _results(spark, d).select("entity_id", S.percent_alive("confidence").alias("pct"))


@query("severity_counts", W(COUNTS_SQL, "scored_results"))
def q_severity_counts(spark, d):
    return _counts(spark, d)


@query("workspace_rollup", W(f"""SELECT count(file_name) AS files,
  CAST(COALESCE(sum(total_symbols), 0) AS BIGINT) AS total_symbols,
  CAST(COALESCE(sum(danger_count), 0) AS BIGINT) AS danger_count,
  CAST(COALESCE(sum(warning_count), 0) AS BIGINT) AS warning_count,
  CAST(COALESCE(sum(review_count), 0) AS BIGINT) AS review_count,
  CAST(COALESCE(sum(safe_count), 0) AS BIGINT) AS safe_count
FROM ({COUNTS_SQL})""", "scored_results"))
def q_workspace_rollup(spark, d):
    return rollups.workspace_rollup(_counts(spark, d))


@query("status_headline", W(f"""SELECT file_name,
  CASE WHEN danger_count > 0 THEN printf('%d dead', danger_count)
       WHEN warning_count > 0 THEN printf('%d warning', warning_count)
       WHEN review_count > 0 THEN printf('%d to review', review_count)
       ELSE printf('Clean (%d)', total_symbols) END AS headline
FROM ({COUNTS_SQL})""", "scored_results"))
def q_status_headline(spark, d):
    return _counts(spark, d).select("file_name", T.status_headline().alias("headline"))


@query("first_file_with_issues", W(f"""SELECT file_name, danger_count + warning_count > 0 AS has_issues
FROM ({COUNTS_SQL}) ORDER BY (danger_count + warning_count <= 0), file_name LIMIT 1""", "scored_results"))
def q_first_file_with_issues(spark, d):
    return rollups.first_file_with_issues(_counts(spark, d))


@query("removable", W("SELECT * FROM scored_results WHERE confidence >= 0.55", "scored_results"))
def q_removable(spark, d):
    return _results(spark, d).where(S.is_removable("confidence"))


@query("safe_to_remove", W("SELECT * FROM scored_results WHERE confidence >= 0.75", "scored_results"))
def q_safe_to_remove(spark, d):
    return _results(spark, d).where(S.is_safe_to_remove("confidence"))


@query("predicted_dead", W("SELECT entity_id, confidence > 0.5 AS is_dead FROM scored_results",
                           "scored_results"))
def q_predicted_dead(spark, d):
    return _results(spark, d).select("entity_id", S.predicted_dead("confidence").alias("is_dead"))


@query("visible_findings", W(f"""SELECT * FROM scored_results
WHERE confidence >= 0.3 AND {sev('confidence')} <> 'safe'""", "scored_results"))
def q_visible_findings(spark, d):
    return _results(spark, d).where(S.is_visible("confidence"))


@query("filter_by_severity", W(f"""SELECT * FROM scored_results WHERE {sev('confidence')} = 'warning'""",
                               "scored_results"))
def q_filter_by_severity(spark, d):
    return _results(spark, d).where(S.severity_band("confidence") == "warning")


@query("top_suspects", W(f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY confidence DESC, entity_id) AS rank
  FROM scored_results WHERE confidence > 0.5) WHERE rank <= {K.TOP_SUSPECTS}""", "scored_results"))
def q_top_suspects(spark, d):
    return ordering.top_suspects(_results(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("sort_results", W("""SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY name, entity_id) AS sort_pos,
  row_number() OVER (PARTITION BY file_name ORDER BY confidence DESC, entity_id) AS pos_confidence,
  row_number() OVER (PARTITION BY file_name ORDER BY start_line, entity_id) AS pos_line
FROM scored_results""", "scored_results"))
def q_sort_results(spark, d):
    r = _results(spark, d)
    by_name = ordering.sort_results(r, mode="name")
    by_conf = ordering.sort_results(by_name.withColumnRenamed("sort_pos", "_n"), mode="confidence") \
        .withColumnRenamed("sort_pos", "pos_confidence")
    by_line = ordering.sort_results(by_conf, mode="line").withColumnRenamed("sort_pos", "pos_line") \
        .withColumnRenamed("_n", "sort_pos")
    return by_line.select(*r.columns, *[F.col(c).cast("long").alias(c) for c in ("sort_pos", "pos_confidence", "pos_line")])


PROBES_SQL = """SELECT event_id AS probe_id, 'src/f' || CAST(user_id AS VARCHAR) || '.py' AS file_name,
  CAST(floor(value) AS INTEGER) + 100 AS line FROM events"""


def _probes(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("probe_id"),
        F.concat(F.lit("src/f"), F.col("user_id").cast("string"), F.lit(".py")).alias("file_name"),
        (F.floor("value").cast("int") + 100).alias("line"))


@query("symbol_at_line", W(f"""
WITH probes AS ({PROBES_SQL}),
m AS (SELECT p.probe_id, s.*, row_number() OVER (PARTITION BY p.probe_id ORDER BY s.start_line, s.entity_id) AS rn
      FROM probes p JOIN scored_results s
        ON s.file_name = p.file_name AND s.start_line <= p.line AND p.line <= s.end_line)
SELECT p.probe_id, p.file_name, p.line,
  CASE WHEN m.confidence >= 0.15 THEN m.entity_id END AS sym_entity_id,
  CASE WHEN m.confidence >= 0.15 THEN m.name END AS sym_name,
  CASE WHEN m.confidence >= 0.15 THEN m.kind END AS sym_kind,
  CASE WHEN m.confidence >= 0.15 THEN m.start_line END AS sym_start_line,
  CASE WHEN m.confidence >= 0.15 THEN m.end_line END AS sym_end_line,
  CASE WHEN m.confidence >= 0.15 THEN m.confidence END AS sym_confidence
FROM probes p LEFT JOIN m ON m.probe_id = p.probe_id AND m.rn = 1""", "scored_results"))
def q_symbol_at_line(spark, d):
    return joins.symbol_at_line(_results(spark, d), _probes(spark, d), min_conf=K.HOVER_MIN)


@query("normalize_results", W("""SELECT ce.name || '_' || CAST(ce.start_line AS VARCHAR) AS id, ce.name,
  CASE WHEN ce.kind = 'class' THEN 'class' ELSE 'function' END AS kind, ce.start_line, ce.end_line,
  ce.confidence, CASE WHEN ce.confidence >= 0.5 THEN ['high', ce.kind] ELSE [] END AS reasons_dead,
  CASE WHEN ce.confidence < 0.5 THEN ['low'] ELSE [] END AS reasons_alive,
  COALESCE(e.summary, '') AS summary, COALESCE(e.xai_json, '') AS explanation,
  CASE WHEN ce.end_line % 4 = 0 THEN '' ELSE 'def ' || ce.name || '():' END AS snippet
FROM scored_results ce LEFT JOIN explanations e ON e.entity_id = ce.entity_id""",
                              "scored_results", "explanations"))
def q_normalize_results(spark, d):
    """Lists and snippets that are there, empty or missing."""
    from ..operators.results import normalize_results
    r = _results(spark, d).withColumns({
        "reasons_dead": F.when(F.col("confidence") >= 0.5, F.array(F.lit("high"), F.col("kind"))),
        "reasons_alive": F.when(F.col("confidence") < 0.5, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>")),
        "snippet": F.when(F.col("end_line") % 4 != 0, F.concat(F.lit("def "), "name", F.lit("():\n    pass")))})
    e = V.explanations(spark, d).select(F.col("entity_id").alias("_eid"), "summary",
                                        F.col("xai_json").alias("explanation"))
    raw = r.join(e, r.entity_id == e._eid, "left")
    return normalize_results(raw)


@query("display_text", W("""SELECT ce.entity_id,
  COALESCE(COALESCE(NULLIF(json_extract_string(CASE WHEN json_valid(e.xai_json) THEN e.xai_json END, '$.summary'), ''),
                    NULLIF(e.summary, '')), '') AS display_summary,
  COALESCE(NULLIF(e.llm_reasoning, ''), NULLIF(e.recommendation, ''),
           'No model reasoning available; showing score-only output.') AS display_reasoning,
  COALESCE(NULLIF(e.confidence_explanation, ''), NULLIF(ce.name, ''), 'No explanation available.') AS display_detail
FROM scored_results ce LEFT JOIN explanations e ON e.entity_id = ce.entity_id""",
                         "scored_results", "explanations"))
def q_display_text(spark, d):
    from ..functions.jsonx import parse_xai_json
    r = _results(spark, d)
    e = V.explanations(spark, d).select(F.col("entity_id").alias("_eid"), "summary", "llm_reasoning",
                                        "recommendation", "confidence_explanation", "xai_json")
    j = r.join(e, r.entity_id == e._eid, "left").withColumn("_x", parse_xai_json("xai_json"))
    return j.select(
        "entity_id",
        T.display_summary(F.col("_x.summary"), "summary").alias("display_summary"),
        T.display_reasoning("llm_reasoning", "recommendation").alias("display_reasoning"),
        T.display_detail("confidence_explanation", "name").alias("display_detail"))
