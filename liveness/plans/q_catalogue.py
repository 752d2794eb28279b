"""Checked queries over the catalogue: part names referenced by line items.

Names repeat across parts (bare-name matching counts every reference to a name for
every entity of that name); references from urgent orders count as test usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores as S
from ..functions import text as T
from ..operators import joins, rollups
from . import views as V
from .registry import query

W = V.with_views

MARKER_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(name), '{m}') THEN '{m}'" for m in K.DEPRECATED_MARKERS) + " END"

REASONS_DEAD_SQL = f"""array_to_string(list_filter([
  CASE WHEN call_count = 0 THEN 'no references to it were found' END,
  CASE WHEN call_count = 1 THEN 'referenced only once, maybe by itself' END,
  CASE WHEN is_exported = 0 THEN 'not exported: the name is private' END,
  CASE WHEN used_in_tests = 0 THEN 'no test file references it' END,
  CASE WHEN dynamic_call_risk <> 1 AND call_count = 0 THEN 'no dynamic invocation, so removal is low-risk' END,
  CASE WHEN cyclomatic_complexity <= 2 THEN printf('very simple body (complexity %d)', cyclomatic_complexity) END,
  CASE WHEN file_depth > 5 THEN printf('deeply nested module (depth %d)', file_depth) END,
  CASE WHEN ({MARKER_SQL}) IS NOT NULL THEN printf('name contains ''%s''', {MARKER_SQL}) END,
  CASE WHEN starts_with(lower(name), '_') AND NOT starts_with(lower(name), '__')
       THEN 'single leading underscore marks internal use' END], lambda x: x IS NOT NULL), ' | ')"""

REASONS_ALIVE_SQL = """array_to_string(list_filter([
  CASE WHEN call_count >= 2 THEN printf('referenced %d times', call_count) END,
  CASE WHEN is_exported <> 0 THEN 'exported: reachable from other modules' END,
  CASE WHEN used_in_tests <> 0 THEN 'referenced from test files' END,
  CASE WHEN dynamic_call_risk = 1 THEN 'dynamic invocation may reach it indirectly' END,
  CASE WHEN cyclomatic_complexity >= 8 THEN printf('substantial logic (complexity %d)', cyclomatic_complexity) END,
  CASE WHEN file_depth <= 2 THEN printf('shallow module (depth %d)', file_depth) END], lambda x: x IS NOT NULL), ' | ')"""

RULE_SQL = """CAST((CASE WHEN call_count = 0 THEN 2.0 WHEN call_count <= 1 THEN 1.0 ELSE 0.0 END
  + CASE WHEN is_exported = 0 THEN 1.0 ELSE 0.0 END + CASE WHEN used_in_tests = 0 THEN 1.0 ELSE 0.0 END
  + CASE WHEN dynamic_call_risk < 0.3 THEN 0.5 ELSE 0.0 END
  + CASE WHEN cyclomatic_complexity < 5 THEN 0.5 ELSE 0.0 END + CASE WHEN file_depth > 5 THEN 0.5 ELSE 0.0 END) AS DOUBLE)"""


def features(spark, d):
    return V.cat_features(spark, d)


def rule_cols():
    score = S.rule_dead_score("call_count", "is_exported", "used_in_tests", "dynamic_call_risk",
                              "cyclomatic_complexity", "file_depth")
    return score


@query("call_counts", W("SELECT callee, count(*) AS call_count FROM cat_calls GROUP BY callee", "cat_calls"))
def q_call_counts(spark, d):
    return rollups.call_counts(V.cat_calls(spark, d))


@query("test_called_names", W("SELECT DISTINCT callee FROM cat_calls WHERE in_test_file", "cat_calls"))
def q_test_called_names(spark, d):
    return rollups.test_called_names(V.cat_calls(spark, d))


@query("attach_call_count", W("""SELECT e.entity_id, e.name, CAST(COALESCE(c.call_count, 0) AS BIGINT) AS call_count
FROM cat_entities e LEFT JOIN cat_counts c ON c.callee = e.name""", "cat_entities", "cat_counts"))
def q_attach_call_count(spark, d):
    counts = rollups.call_counts(V.cat_calls(spark, d))
    return joins.attach_call_count(V.cat_entities(spark, d), counts).select("entity_id", "name", "call_count")


@query("attach_test_usage", W("""SELECT e.entity_id, e.name, CASE WHEN t.callee IS NOT NULL THEN 1 ELSE 0 END AS used_in_tests
FROM cat_entities e LEFT JOIN cat_tests t ON t.callee = e.name""", "cat_entities", "cat_tests"))
def q_attach_test_usage(spark, d):
    tests = rollups.test_called_names(V.cat_calls(spark, d))
    return joins.attach_test_usage(V.cat_entities(spark, d), tests).select("entity_id", "name", "used_in_tests")


@query("is_exported", W("""SELECT entity_id, name, CASE WHEN starts_with(name, '_') THEN 0 ELSE 1 END AS is_exported
FROM cat_entities""", "cat_entities"))
def q_is_exported(spark, d):
    return V.cat_entities(spark, d).select("entity_id", "name", S.is_exported("name").alias("is_exported"))


@query("is_private_name", W("""SELECT entity_id, name,
  starts_with(lower(name), '_') AND NOT starts_with(lower(name), '__') AS is_private FROM cat_entities""",
                            "cat_entities"))
def q_is_private_name(spark, d):
    return V.cat_entities(spark, d).select("entity_id", "name", S.is_private_name("name").alias("is_private"))


@query("deprecated_marker", W(f"""SELECT entity_id, name, {MARKER_SQL} AS marker FROM cat_entities""", "cat_entities"))
def q_deprecated_marker(spark, d):
    return V.cat_entities(spark, d).select("entity_id", "name", S.deprecated_marker("name").alias("marker"))


@query("file_depth", W("""SELECT entity_id, rel_path,
  CAST(length(rel_path) - length(replace(rel_path, '/', '')) AS INTEGER) AS file_depth FROM cat_entities""",
                       "cat_entities"))
def q_file_depth(spark, d):
    return V.cat_entities(spark, d).select("entity_id", "rel_path", S.file_depth("rel_path").alias("file_depth"))


@query("catalogue_features", W("SELECT * FROM cat_features", "cat_features"))
def q_catalogue_features(spark, d):
    return features(spark, d)


@query("rule_dead_score", W(f"""SELECT entity_id, {RULE_SQL} AS rule_score,
  1.0 / (1.0 + exp(-{RULE_SQL})) > 0.5 AS rule_label FROM cat_features""", "cat_features"))
def q_rule_dead_score(spark, d):
    s = rule_cols()
    return features(spark, d).select("entity_id", s.alias("rule_score"),
                                     (S.sigmoid(s) > 0.5).alias("rule_label"))


@query("reasons_dead", W(f"SELECT entity_id, {REASONS_DEAD_SQL} AS reasons FROM cat_features", "cat_features"))
def q_reasons_dead(spark, d):
    return features(spark, d).select("entity_id", F.array_join(T.reasons_dead("name"), " | ").alias("reasons"))


@query("reasons_alive", W(f"SELECT entity_id, {REASONS_ALIVE_SQL} AS reasons FROM cat_features", "cat_features"))
def q_reasons_alive(spark, d):
    return features(spark, d).select("entity_id", F.array_join(T.reasons_alive(), " | ").alias("reasons"))


@query("class_distribution", W(f"""SELECT CAST(1.0 / (1.0 + exp(-{RULE_SQL})) > 0.5 AS INTEGER) AS label,
  count(*) AS rows FROM cat_features GROUP BY 1""", "cat_features"))
def q_class_distribution(spark, d):
    lab = (S.sigmoid(rule_cols()) > 0.5).cast("int").alias("label")
    return rollups.class_distribution(features(spark, d).select(lab))
