"""Queries over the derived source corpus: AST extraction and the flagship analysis.

The corpus is generated from the tables, so what a correct parse must yield (entities,
lines, complexity, snippets, calls) is recomputed in SQL from the same tables; the
oracle SQL of the extraction queries and of ``analyze_corpus`` builds on that. The AST
pass itself is also tested against brute-force definitions on fixture trees (tests/)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import extract as X
from ..operators.rollups import call_counts
from ..session import materialize, new_stage_path
from ..sources.files import write_tree
from .analyze import analyze_corpus
from .corpus import corpus_files
from . import views as V
from .registry import query

W = V.with_views

def _extracted(spark, d, *unused):
    """The extraction stage of a corpus: parsed and written anew by every query, without columns it has no use for."""
    return materialize(X.extract(corpus_files(spark, d)).drop(*unused), "extract")


def _entities(spark, d, *columns):
    """The entities of a corpus, parsed and written anew: of the stage, what the query returns."""
    return materialize(X.entities_of(X.extract(corpus_files(spark, d), kinds=["entity"])).select("entity_type", *columns), "entities")


def _calls(spark, d):
    """The calls of a corpus, parsed and written anew."""
    return X.calls_of(materialize(X.extract(corpus_files(spark, d), kinds=["call"]).select("kind", "path", "callee"), "calls"))


def _analyze_sql(part: str = "all") -> str:
    """The flagship's rows in SQL: all columns, or the ``numbers`` or the ``texts`` with the entity's place."""
    from .q_catalogue import REASONS_ALIVE_SQL, REASONS_DEAD_SQL
    from .q_model import _contrib_sql, _logit_sql, _stats_sql, _z_sql, summary_sql
    from .registry import snap_sql
    pct = "CAST(trunc(conf_raw * 100) AS INTEGER)"
    q = "''"  # an escaped quote inside SQL string literals
    place = "s.path, s.name, s.entity_type, s.start_line, s.end_line"
    numbers = f"""s.call_count, s.is_exported, s.used_in_tests,
  s.dynamic_call_risk, s.cyclomatic_complexity, s.file_depth, {snap_sql('conf_raw')} AS confidence,
  CASE WHEN conf_raw >= 0.75 THEN 'danger' WHEN conf_raw >= 0.55 THEN 'warning'
       WHEN conf_raw >= 0.35 THEN 'review' ELSE 'safe' END AS severity"""
    texts = f"""{REASONS_DEAD_SQL} AS reasons_dead, {REASONS_ALIVE_SQL} AS reasons_alive,
  {summary_sql('conf_raw', 's.name')} AS summary,
  concat_ws('; ',
    CASE WHEN call_count = 0 THEN printf('{q}%s{q} has no references', s.name)
         WHEN call_count = 1 THEN printf('{q}%s{q} has a single reference', s.name)
         ELSE printf('{q}%s{q} has %d references', s.name, call_count) END,
    CASE WHEN is_exported = 0 THEN 'it is private' ELSE 'it is public' END,
    CASE WHEN used_in_tests = 0 THEN 'no test references it' ELSE 'tests reference it' END,
    CASE WHEN dynamic_call_risk = 1 THEN 'it may be invoked by name at run time' END,
    CASE WHEN cyclomatic_complexity <= 2 THEN printf('simple logic (complexity %d)', cyclomatic_complexity)
         WHEN cyclomatic_complexity >= 8 THEN printf('complex logic (complexity %d)', cyclomatic_complexity)
         ELSE printf('moderate complexity (%d)', cyclomatic_complexity) END)
    || printf(' [score %d of 100]', {pct}) AS explanation,
  c.top_features, s.snippet"""
    contrib = f""",
contrib AS MATERIALIZED (SELECT ekey, string_agg(name || ':' || printf('%.4f', contribution), ';' ORDER BY rank) AS top_features
  FROM (SELECT *, row_number() OVER (PARTITION BY ekey ORDER BY abs(contribution) DESC, idx) AS rank
        FROM ({_contrib_sql("ekey")})) GROUP BY ekey)"""
    columns = {"all": [numbers, texts], "numbers": [numbers], "texts": [texts]}[part]
    return W(f"""WITH used AS MATERIALIZED (SELECT callee, count(*) AS n, bool_or(in_test_file) AS tested FROM corpus_calls GROUP BY callee),
feats AS MATERIALIZED (
  SELECT e.path, e.name, e.entity_type, e.start_line, e.end_line, e.cyclomatic_complexity, e.dynamic_call_risk,
    e.snippet, CAST(COALESCE(u.n, 0) AS BIGINT) AS call_count,
    CASE WHEN u.tested THEN 1 ELSE 0 END AS used_in_tests,
    CASE WHEN starts_with(e.name, '_') THEN 0 ELSE 1 END AS is_exported,
    CAST(length(e.path) - length(replace(e.path, '/', '')) AS INTEGER) AS file_depth,
    e.path || '#' || CAST(e.start_line AS VARCHAR) || '#' || e.name AS ekey
  FROM corpus_entities e LEFT JOIN used u ON u.callee = e.name),
stats AS MATERIALIZED ({_stats_sql("feats")}), z AS MATERIALIZED ({_z_sql("feats")}),
scored AS MATERIALIZED (SELECT *, 1.0 / (1.0 + exp(-{_logit_sql()})) AS conf_raw FROM z){contrib if part != "numbers" else ""}
SELECT {", ".join([place, *columns])}
FROM scored s {"JOIN contrib c ON c.ekey = s.ekey" if part != "numbers" else ""}""", "corpus_entities", "corpus_calls")


def full_analysis(spark, d):
    """The flagship result, with the list columns flattened to text for comparison:
    reasons joined by ' | ', ranked contributions as 'name:0.1234;...'."""
    results, _errors = analyze_corpus(None, extracted=_extracted(spark, d))
    return (results
            .withColumn("reasons_dead", F.array_join("reasons_dead", " | "))
            .withColumn("reasons_alive", F.array_join("reasons_alive", " | "))
            .withColumn("top_features", F.array_join(F.transform(
                "top_features", lambda x: F.concat(x["name"], F.lit(":"),
                                                   F.format_string("%.4f", x["contribution"]))), ";")))


PLACE = ["path", "name", "entity_type", "start_line", "end_line"]
TEXTS = ["reasons_dead", "reasons_alive", "summary", "explanation", "top_features", "snippet"]


@query("analyze_corpus", _analyze_sql())
def q_analyze_corpus(spark, d):
    """The flagship whole: features, scores, bands and texts."""
    return full_analysis(spark, d)


@query("analyze_corpus_texts", _analyze_sql("texts"))
def q_analyze_corpus_texts(spark, d):
    return full_analysis(spark, d).select(*PLACE, *TEXTS)


@query("extract_entities", W("SELECT path, name, entity_type, start_line, end_line FROM corpus_entities", "corpus_entities"))
def q_extract_entities(spark, d):
    return _entities(spark, d, "path", "name", "start_line", "end_line").select("path", "name", "entity_type", "start_line", "end_line")


@query("extract_calls", W("SELECT * FROM corpus_calls", "corpus_calls"))
def q_extract_calls(spark, d):
    return _calls(spark, d)


@query("call_counts_corpus", W("SELECT callee, count(*) AS call_count FROM corpus_calls GROUP BY callee", "corpus_calls"))
def q_call_counts_corpus(spark, d):
    return call_counts(_calls(spark, d))


@query("cyclomatic_complexity", W("""SELECT path, name, start_line, cyclomatic_complexity
FROM corpus_entities WHERE entity_type = 'function'""", "corpus_entities"))
def q_cyclomatic_complexity(spark, d):
    return _entities(spark, d, "path", "name", "start_line", "cyclomatic_complexity").where(F.col("entity_type") == "function") \
        .drop("entity_type")


@query("class_method_count", W("""SELECT path, name, start_line, cyclomatic_complexity AS method_count
FROM corpus_entities WHERE entity_type = 'class'""", "corpus_entities"))
def q_class_method_count(spark, d):
    return _entities(spark, d, "path", "name", "start_line", "cyclomatic_complexity").where(F.col("entity_type") == "class") \
        .select("path", "name", "start_line", F.col("cyclomatic_complexity").alias("method_count"))


@query("dynamic_call_risk", W("SELECT path, name, start_line, dynamic_call_risk FROM corpus_entities", "corpus_entities"))
def q_dynamic_call_risk(spark, d):
    return _entities(spark, d, "path", "name", "start_line", "dynamic_call_risk").drop("entity_type")


@query("entity_snippet", W("""SELECT path, name, start_line, snippet,
  split_part(trim(snippet), chr(10), 1) AS first_line FROM corpus_entities""", "corpus_entities"))
def q_entity_snippet(spark, d):
    e = _entities(spark, d, "path", "name", "start_line", "snippet")
    return e.select("path", "name", "start_line", "snippet",
                    F.split(F.trim(F.col("snippet")), "\n").getItem(0).alias("first_line"))


@query("parse_errors", W("""SELECT DISTINCT rel_path AS path, 'SyntaxError' AS error_kind
FROM corpus_items WHERE broken""", "corpus_items"))
def q_parse_errors(spark, d):
    return X.errors_of(_extracted(spark, d)).select(
        "path", F.substring_index("error", ":", 1).alias("error_kind"))


#: Modules of this many orders in sequence make one file of the written tree.
ORDERS_PER_FILE = 512


@query("scan_files", W(f"""SELECT rel_path, 'py' AS ext, 'python' AS language, CAST(strlen(content) AS BIGINT) AS length,
  sha256(content) AS content_sha256 FROM (
    SELECT parent || 'pkg' || CAST(o // {ORDERS_PER_FILE} AS VARCHAR) || '.py' AS rel_path,
      string_agg(content, chr(10) ORDER BY o) AS content
    FROM (SELECT content, regexp_replace(rel_path, '[^/]+$', '') AS parent,
                 CAST(regexp_extract(rel_path, '([0-9]+)[.]py$', 1) AS BIGINT) AS o FROM corpus_files)
    WHERE NOT contains(parent, '/legacy/') GROUP BY parent, o // {ORDERS_PER_FILE})""", "corpus_files"))
def q_scan_files(spark, d):
    """Write the derived modules as a tree of files (each by the task that has it), scan it back; one directory is excluded."""
    from ..sources.files import scan_files
    root = new_stage_path(spark, "tree")
    o = F.regexp_extract("rel_path", r"([0-9]+)\.py$", 1).cast("long")
    files = (corpus_files(spark, d).select("content", F.regexp_replace("rel_path", "[^/]+$", "").alias("parent"), o.alias("o"))
             .withColumn("pkg", F.floor(F.col("o") / ORDERS_PER_FILE))
             .groupBy("parent", "pkg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "content"))),
                                                                    lambda x: x["content"]), "\n").alias("content"))
             .withColumn("rel_path", F.concat("parent", F.lit("pkg"), F.col("pkg").cast("string"), F.lit(".py"))))
    write_tree(files, root)
    return scan_files(spark, root, exclude=["legacy"]).select(
        "rel_path", "ext", "language", "length", F.sha2("content", 256).alias("content_sha256"))


@query("is_test_file", W("""SELECT rel_path, contains(lower(rel_path), 'test_') OR contains(lower(rel_path), '_test')
  OR contains(lower(rel_path), 'tests') OR contains(lower(rel_path), 'spec') AS is_test, true AS below_specs,
  contains(lower(rel_path), 'test_') OR contains(lower(rel_path), '_test') OR contains(lower(rel_path), 'tests')
    OR contains(lower(rel_path), 'spec') AS below_src FROM corpus_files""", "corpus_files"))
def q_is_test_file(spark, d):
    return corpus_files(spark, d).select("rel_path", S.is_test_file("rel_path").alias("is_test"),
                                         S.is_test_file("rel_path", absolute="/data/Specs/x").alias("below_specs"),
                                         S.is_test_file("rel_path", absolute="/data/src/").alias("below_src"))
