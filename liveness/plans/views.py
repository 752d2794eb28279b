"""Derived tables: the analysis data model re-expressed over the driver tables.

Each view exists twice, side by side: as a Spark DataFrame (used by the registered
queries) and as a DuckDB CTE (used by the oracle SQL). Every view reads whole tables;
nothing is sampled or capped.

  sessions          <- orders    (one analysis run per order, project = customer)
  code_entities     <- lineitem  (one scored symbol per line item, file = supplier)
  explanations      <- lineitem  (returned items; 'R' items get two, some bad JSON)
  feature_vectors   <- lineitem  (finished items)
  removal_logs      <- events
  chat_history      <- conversations (user turn + the next assistant turn)
  users             <- customer
  raw_records       <- events, all columns as text with null tokens injected
  cat_entities      <- part      (catalogue symbols; name from p_name, so names repeat)
  cat_calls         <- lineitem x part x orders (reference to the part's name;
                       references from urgent orders count as test usage)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# ----------------------------------------------------------------------------- Spark


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("proj/"), F.col("o_custkey").cast("string")).alias("project_path"),
        F.col("o_orderdate").alias("timestamp"),
        F.lit(1).alias("total_files"),
    )


def _entity_id():
    """60-bit id from md5 of the unique (order, line, part, supplier) key."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def code_entities(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("l_linenumber") * 100 + F.round(F.col("l_quantity")).cast("int") * 2
    return table(spark, d, "lineitem").select(
        _entity_id().alias("id"),
        F.col("l_orderkey").alias("session_id"),
        F.concat(F.lit("src/f"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("file_name"),
        F.concat(F.lit("fn_"), F.col("l_partkey").cast("string")).alias("entity_name"),
        F.when(F.col("l_linenumber") == 1, "class").otherwise("function").alias("entity_type"),
        start.alias("start_line"),
        (start + F.round(F.col("l_tax") * 100).cast("int") + 1).alias("end_line"),
        (F.col("l_discount") * 10).alias("confidence_score"),
    )


def scored_results(spark: SparkSession, d: str) -> DataFrame:
    """code_entities in the result-row shape used by the per-file operators."""
    return code_entities(spark, d).select(
        F.col("id").alias("entity_id"), "file_name", F.col("entity_name").alias("name"),
        F.col("entity_type").alias("kind"), "start_line", "end_line",
        F.col("confidence_score").alias("confidence"))


def explanations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    eid = _entity_id()
    risk = F.when(F.col("l_linestatus") == "O", "High").otherwise("Low")
    summary = F.concat(F.lit("entity fn_"), F.col("l_partkey").cast("string"), F.lit(" reviewed"))
    xai = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 3), F.lit("{not json"))\
        .otherwise(F.concat(F.lit('{"summary": "'), summary, F.lit('", "risk_level": "'), risk, F.lit('"}')))
    base = li.select(
        eid.alias("entity_id"), summary.alias("summary"), risk.alias("risk_level"),
        F.lit("score-only confidence").alias("confidence_explanation"),
        F.lit("").alias("llm_reasoning"), F.lit("see its callers").alias("recommendation"),
        F.when(F.col("l_discount") >= 0.075, "remove").otherwise("review").alias("action"),
        xai.alias("xai_json"), F.col("l_shipdate").alias("timestamp"), F.col("l_returnflag").alias("_rf"))
    first = base.withColumn("id", F.col("entity_id") * 2)
    second = base.where(F.col("_rf") == "R").withColumn("id", F.col("entity_id") * 2 + 1)
    cols = ["id", "entity_id", "summary", "risk_level", "confidence_explanation", "llm_reasoning",
            "recommendation", "action", "xai_json", "timestamp"]
    return first.select(*cols).unionByName(second.select(*cols))


def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_linestatus") == "F")
    return li.select(
        _entity_id().alias("id"), _entity_id().alias("entity_id"),
        (F.round(F.col("l_quantity")).cast("int") - 1).alias("call_count"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("is_exported"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("used_in_tests"),
        F.col("l_tax").alias("dynamic_call_risk"),
        (F.col("l_linenumber") + 1).alias("cyclomatic_complexity"),
        F.col("l_linenumber").alias("file_depth"),
    )


def removal_logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.lit(0).cast("long").alias("entity_id"),
        F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("file_name"),
        F.col("props").alias("removed_code"),
        (F.col("value") / 500.0).alias("confidence_score"),
        F.col("ts").alias("timestamp"),
    )


def chat_history(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return u.join(a, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        "query", "response",
        F.concat(F.lit("src/f"), F.col("conv_id").cast("string"), F.lit(".py")).alias("context_file"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, conv_id, turn, 0)").alias("timestamp"),
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    email = F.when(F.col("c_mktsegment") == "BUILDING",
                   F.concat(F.lit("no-email-"), F.col("c_custkey").cast("string"))).otherwise(
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@"),
                 F.lower(F.col("c_mktsegment")),
                 F.when(F.col("c_nationkey") < 5, ".edu").otherwise(".com")))
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
                    email.alias("email"), (F.col("c_acctbal") > 0).alias("active"),
                    F.col("c_nationkey").alias("nation"))


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    whole = F.floor(F.col("value")).cast("long").cast("string")
    value = (F.when(F.col("event_type") == "error", F.lit("N/A"))
             .when(F.col("event_type") == "signup", F.lit(""))
             .when(F.col("event_type") == "view", whole)
             .when(F.col("event_type") == "click", F.concat(F.lit("BAD_"), F.col("user_id").cast("string")))
             .otherwise(F.concat(F.lit("-"), whole)))
    status = F.when(F.col("event_type") == "view", F.lit("NULL")).otherwise(
        F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
    return e.select(F.col("event_id").cast("string").alias("id"), value.alias("value"),
                    status.alias("status"), F.col("props").alias("props"),
                    F.col("user_id").cast("string").alias("user_id"))


def _cat_name(prefix: str = ""):
    p = lambda c: F.col(prefix + c)
    return F.concat(F.when(p("p_type") == "SMALL", "_").when(p("p_type") == "PROMO", "__").otherwise(""),
                    F.replace(p("p_name"), F.lit(" "), F.lit("_")))


def cat_entities(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    depth = F.floor(F.col("p_size") / 7).cast("int")
    return p.select(
        F.col("p_partkey").alias("entity_id"), _cat_name().alias("name"),
        F.when(F.col("p_size") > 40, "class").otherwise("function").alias("entity_type"),
        F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), 1).otherwise(0).alias("dynamic_call_risk"),
        (F.floor(F.col("p_size") / 4).cast("int") + 1).alias("cyclomatic_complexity"),
        F.concat(F.repeat(F.lit("sub/"), depth), F.lit("part_"), F.col("p_partkey").cast("string"),
                 F.lit(".py")).alias("rel_path"),
    )


def cat_calls(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return (li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
            .select(F.concat(F.lit("orders/o"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("path"),
                    _cat_name().alias("callee"),
                    (F.col("o_orderpriority") == "1-URGENT").alias("in_test_file")))


DOC_EXT = {"en": ".py", "de": ".js", "es": ".ts", "fr": ".tsx"}


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    """documents as a source tree: German documents sit below an excluded build/ dir."""
    from ..sources.files import detect_language
    ext = F.element_at(F.create_map(*[x for k, v in DOC_EXT.items() for x in (F.lit(k), F.lit(v))]),
                       F.col("lang"))
    path = F.concat(F.when(F.col("lang") == "de", "build/").otherwise(""), F.col("source"), F.lit("/"),
                    F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    docs = table(spark, d, "documents").select("doc_id", path.alias("path"), F.col("text").alias("content"))
    return docs.withColumn("language", detect_language("path"))


def cat_features(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entities with the six model features attached."""
    from ..operators.joins import attach_features
    return attach_features(cat_entities(spark, d), cat_calls(spark, d), name="name",
                           path="rel_path", callee="callee", in_test="in_test_file")


# ----------------------------------------------------------------------------- SQL

VIEW_SQL = {
    "sessions": """SELECT o_orderkey AS id, 'proj/' || CAST(o_custkey AS VARCHAR) AS project_path,
        o_orderdate AS "timestamp", 1 AS total_files FROM orders""",
    "code_entities": """SELECT ('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR)), 1, 15))::BIGINT AS id, l_orderkey AS session_id,
        'src/f' || CAST(l_suppkey AS VARCHAR) || '.py' AS file_name,
        'fn_' || CAST(l_partkey AS VARCHAR) AS entity_name,
        CASE WHEN l_linenumber = 1 THEN 'class' ELSE 'function' END AS entity_type,
        l_linenumber * 100 + CAST(round(l_quantity) AS INTEGER) * 2 AS start_line,
        l_linenumber * 100 + CAST(round(l_quantity) AS INTEGER) * 2 + CAST(round(l_tax * 100) AS INTEGER) + 1 AS end_line,
        l_discount * 10 AS confidence_score FROM lineitem""",
    "scored_results": """SELECT id AS entity_id, file_name, entity_name AS name, entity_type AS kind,
        start_line, end_line, confidence_score AS confidence FROM code_entities""",
    "explanations": """SELECT * EXCLUDE (_rf) FROM (
        SELECT entity_id * 2 AS id, * FROM expl_base
        UNION ALL
        SELECT entity_id * 2 + 1 AS id, * FROM expl_base WHERE _rf = 'R')""",
    "expl_base": """SELECT ('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR)), 1, 15))::BIGINT AS entity_id,
        'entity fn_' || CAST(l_partkey AS VARCHAR) || ' reviewed' AS summary,
        CASE WHEN l_linestatus = 'O' THEN 'High' ELSE 'Low' END AS risk_level,
        'score-only confidence' AS confidence_explanation, '' AS llm_reasoning,
        'see its callers' AS recommendation,
        CASE WHEN l_discount >= 0.075 THEN 'remove' ELSE 'review' END AS action,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN '{not json'
             ELSE '{"summary": "entity fn_' || CAST(l_partkey AS VARCHAR) || ' reviewed", "risk_level": "'
                  || CASE WHEN l_linestatus = 'O' THEN 'High' ELSE 'Low' END || '"}' END AS xai_json,
        l_shipdate AS "timestamp", l_returnflag AS _rf
        FROM lineitem WHERE l_returnflag IN ('A', 'R')""",
    "feature_vectors": """SELECT ('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR)), 1, 15))::BIGINT AS id, ('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR)), 1, 15))::BIGINT AS entity_id,
        CAST(round(l_quantity) AS INTEGER) - 1 AS call_count,
        CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS is_exported,
        CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS used_in_tests,
        l_tax AS dynamic_call_risk, l_linenumber + 1 AS cyclomatic_complexity, l_linenumber AS file_depth
        FROM lineitem WHERE l_linestatus = 'F'""",
    "removal_logs": """SELECT event_id AS id, CAST(0 AS BIGINT) AS entity_id,
        'src/u' || CAST(user_id AS VARCHAR) || '.py' AS file_name, props AS removed_code,
        value / 500.0 AS confidence_score, ts AS "timestamp" FROM events""",
    "chat_history": """SELECT u.conv_id * 1000 + u.turn AS id, u.text AS query, a.text AS response,
        'src/f' || CAST(u.conv_id AS VARCHAR) || '.py' AS context_file,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(u.conv_id) + to_minutes(u.turn) AS "timestamp"
        FROM (SELECT * FROM conversations WHERE role = 'user') u
        LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
          ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn""",
    "users": """SELECT c_custkey AS user_id, c_name AS name,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'no-email-' || CAST(c_custkey AS VARCHAR)
             ELSE lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment)
                  || CASE WHEN c_nationkey < 5 THEN '.edu' ELSE '.com' END END AS email,
        c_acctbal > 0 AS active, c_nationkey AS nation FROM customer""",
    "raw_records": """SELECT CAST(event_id AS VARCHAR) AS id,
        CASE event_type WHEN 'error' THEN 'N/A' WHEN 'signup' THEN ''
             WHEN 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
             WHEN 'click' THEN 'BAD_' || CAST(user_id AS VARCHAR)
             ELSE '-' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value,
        CASE WHEN event_type = 'view' THEN 'NULL' ELSE ' ' || event_type || ' ' END AS status,
        props, CAST(user_id AS VARCHAR) AS user_id FROM events""",
    "cat_entities": """SELECT p_partkey AS entity_id,
        CASE WHEN p_type = 'SMALL' THEN '_' WHEN p_type = 'PROMO' THEN '__' ELSE '' END || replace(p_name, ' ', '_') AS name,
        CASE WHEN p_size > 40 THEN 'class' ELSE 'function' END AS entity_type,
        CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 1 ELSE 0 END AS dynamic_call_risk,
        CAST(floor(p_size / 4) AS INTEGER) + 1 AS cyclomatic_complexity,
        repeat('sub/', CAST(floor(p_size / 7) AS INTEGER)) || 'part_' || CAST(p_partkey AS VARCHAR) || '.py' AS rel_path
        FROM part""",
    "cat_calls": """SELECT 'orders/o' || CAST(l_orderkey AS VARCHAR) || '.py' AS path,
        CASE WHEN p_type = 'SMALL' THEN '_' WHEN p_type = 'PROMO' THEN '__' ELSE '' END || replace(p_name, ' ', '_') AS callee,
        o_orderpriority = '1-URGENT' AS in_test_file
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "doc_files": """SELECT doc_id, CASE WHEN lang = 'de' THEN 'build/' ELSE '' END || source || '/' || lang || '/doc_'
        || CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.js' WHEN 'es' THEN '.ts'
        WHEN 'fr' THEN '.tsx' END AS path, text AS content,
        CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'javascript' WHEN 'es' THEN 'typescript'
        WHEN 'fr' THEN 'typescriptreact' END AS language FROM documents""",
    "cat_counts": "SELECT callee, count(*) AS call_count FROM cat_calls GROUP BY callee",
    "cat_tests": "SELECT DISTINCT callee FROM cat_calls WHERE in_test_file",
    "cat_features": """SELECT e.*, CAST(COALESCE(c.call_count, 0) AS BIGINT) AS call_count,
        CASE WHEN t.callee IS NOT NULL THEN 1 ELSE 0 END AS used_in_tests,
        CASE WHEN starts_with(e.name, '_') THEN 0 ELSE 1 END AS is_exported,
        CAST(length(e.rel_path) - length(replace(e.rel_path, '/', '')) AS INTEGER) AS file_depth
        FROM cat_entities e LEFT JOIN cat_counts c ON c.callee = e.name
        LEFT JOIN cat_tests t ON t.callee = e.name""",
}

# views that other views are built from
VIEW_DEPS = {
    "cat_counts": ["cat_calls"],
    "cat_tests": ["cat_calls"],
    "cat_features": ["cat_entities", "cat_counts", "cat_tests"],
    "scored_results": ["code_entities"],
    "explanations": ["expl_base"],
}


def with_views(body: str, *names: str) -> str:
    """``WITH`` clause defining the named views (and what they depend on) + ``body``."""
    from .corpus import CORPUS_DEPS, CORPUS_SQL
    VIEW_SQL.update(CORPUS_SQL)
    VIEW_DEPS.update(CORPUS_DEPS)
    ordered: list[str] = []

    def add(n: str) -> None:
        for dep in VIEW_DEPS.get(n, []):
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    kept = lambda n: "MATERIALIZED " if n in CORPUS_SQL else ""  # noqa: E731  read several times each
    ctes = ",\n".join(f"{n} AS {kept(n)}({VIEW_SQL[n]})" for n in ordered)
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":
        return f"WITH {ctes},\n{stripped[4:]}"
    return f"WITH {ctes}\n{body}"
