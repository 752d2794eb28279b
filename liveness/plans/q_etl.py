"""Checked queries: record cleaning (events as untyped text records) and user hygiene
(customers as users)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import text as T
from ..operators import ordering, rollups
from ..operators import users as U
from ..session import materialize, table
from . import views as V
from .registry import query, snap_sql

W = V.with_views

NULLTOK = "({c} IS NULL OR {c} IN ('', 'NULL', 'N/A'))"


def nt(c: str) -> str:
    return NULLTOK.format(c=c)


CLEAN_SQL = f"""SELECT CASE WHEN {nt('id')} THEN NULL ELSE id END AS id,
  CASE WHEN {nt('value')} THEN NULL WHEN regexp_full_match(value, '[0-9]+')
       THEN CASE WHEN length(ltrim(value, '0')) > 38 THEN NULL ELSE CAST(value AS DECIMAL(38,0)) END
       ELSE CAST(-1 AS DECIMAL(38,0)) END AS value,
  CASE WHEN regexp_full_match(value, '[0-9]+') AND length(ltrim(value, '0')) > 38 THEN value END AS value_quarantine,
  CASE WHEN {nt('status')} THEN NULL ELSE upper(trim(status)) END AS status,
  CASE WHEN {nt('props')} THEN NULL ELSE props END AS props,
  CASE WHEN {nt('user_id')} THEN NULL ELSE user_id END AS user_id
FROM raw_records"""


def _raw(spark, d):
    return V.raw_records(spark, d)


def _clean(spark, d):
    return C.clean_records(_raw(spark, d))


@query("normalize_nulls", W(f"""SELECT {', '.join(f"CASE WHEN {nt(c)} THEN NULL ELSE {c} END AS {c}"
                                                   for c in ('id', 'value', 'status', 'props', 'user_id'))}
FROM raw_records""", "raw_records"))
def q_normalize_nulls(spark, d):
    return C.normalize_nulls(_raw(spark, d))


@query("sanitize_text", W("SELECT id, upper(trim(status)) AS status FROM raw_records", "raw_records"))
def q_sanitize_text(spark, d):
    return _raw(spark, d).select("id", C.sanitize_text("status").alias("status"))


@query("clean_records", W(CLEAN_SQL, "raw_records"))
def q_clean_records(spark, d):
    return _clean(spark, d)


@query("evaluate_formula", W(f"""SELECT id, CAST(value AS BIGINT) * CAST(user_id AS BIGINT) + 2 AS result FROM ({CLEAN_SQL})""",
                             "raw_records"))
def q_evaluate_formula(spark, d):
    c = _clean(spark, d).withColumn("uid", F.col("user_id").cast("bigint")).withColumn("value", F.col("value").cast("bigint"))
    return C.evaluate_formula(c, "x * y + 2", {"x": "value", "y": "uid"}).select("id", "result")


@query("average_column", W(f"SELECT {snap_sql('COALESCE(avg(value), 0.0)', 6)} AS avg_value FROM ({CLEAN_SQL})",
                           "raw_records"))
def q_average_column(spark, d):
    from ..functions.scores import round_half_up
    return rollups.average_column(_clean(spark, d), "value").select(
        round_half_up("avg_value", 6).alias("avg_value"))


@query("group_sum", W(f"SELECT status, CAST(sum(value) AS BIGINT) AS sum_value FROM ({CLEAN_SQL}) GROUP BY status",
                      "raw_records"))
def q_group_sum(spark, d):
    return rollups.group_sum(_clean(spark, d), "status", "value").withColumn("sum_value", F.col("sum_value").cast("bigint"))


@query("format_date_text", """SELECT event_id, replace(strftime(ts, '%Y/%m/%d'), '/', '-') AS day FROM events""")
def q_format_date_text(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", T.format_date_text(F.date_format("ts", "yyyy/MM/dd")).alias("day"))


@query("nested_get", """SELECT event_id, COALESCE(json_extract_string(props, '$.k'), 'none') AS k,
  COALESCE(json_extract_string(props, '$.k.z'), 'none') AS k_z FROM events""")
def q_nested_get(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", T.nested_get("props", "k", default="none").alias("k"),
                    T.nested_get("props", "k", "z", default="none").alias("k_z"))


# --- users -------------------------------------------------------------------------

@query("active_records", W("SELECT * FROM users WHERE active", "users"))
def q_active_records(spark, d):
    return V.users(spark, d).where(F.col("active"))


@query("paginate", W("""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY nation ORDER BY user_id) AS row_no FROM users)
WHERE row_no > 10 AND row_no <= 20""", "users"))
def q_paginate(spark, d):
    return ordering.paginate(V.users(spark, d), ["user_id"], page=2, per_page=10, group="nation") \
        .withColumn("row_no", F.col("row_no").cast("long"))


@query("paginate_deep", W("""SELECT * FROM code_entities ORDER BY id LIMIT 10 OFFSET 4990""", "code_entities"))
def q_paginate_deep(spark, d):
    """Page 500 of all entities by id, from a seek index: only the range that holds it is read."""
    return ordering.page_index(V.code_entities(spark, d), ["id"]).page(500, 10)


@query("mask_email", W("""SELECT user_id, CASE WHEN NOT contains(email, '@') THEN '***'
  ELSE substr(split_part(email, '@', 1), 1, 2) || '***@' || substr(email, strpos(email, '@') + 1) END AS masked
FROM users""", "users"))
def q_mask_email(spark, d):
    return V.users(spark, d).select("user_id", T.mask_email("email").alias("masked"))


@query("format_display", W("""SELECT user_id, COALESCE(name, 'Unknown') || ' <' || COALESCE(email, '') || '>' AS display
FROM users""", "users"))
def q_format_display(spark, d):
    return V.users(spark, d).select("user_id", T.format_display("name", "email").alias("display"))


@query("short_hash_id", W("SELECT user_id, substr(md5(email), 1, 8) AS short_id FROM users", "users"))
def q_short_hash_id(spark, d):
    return V.users(spark, d).select("user_id", T.short_hash_id("email").alias("short_id"))


@query("engagement_score", W("""SELECT user_id, CAST(CASE WHEN active THEN 10.0 ELSE 0.0 END
  + CASE WHEN ends_with(COALESCE(email, ''), '.edu') THEN 5.0 ELSE 0.0 END
  + CASE WHEN length(COALESCE(name, '')) > 3 THEN 2.0 ELSE 0.0 END AS DOUBLE) AS score FROM users""", "users"))
def q_engagement_score(spark, d):
    return V.users(spark, d).select("user_id", T.engagement_score("active", "email", "name").cast("double")
                                    .alias("score"))


@query("valid_row", W("SELECT user_id, contains(email, '@') AND length(email) > 5 AS valid FROM users", "users"))
def q_valid_row(spark, d):
    return V.users(spark, d).select("user_id", T.valid_row("email").alias("valid"))


LEGACY_SQL = """SELECT user_id AS line_no, CASE WHEN active THEN ' ' || name || ',' || email || ',legacy ' ELSE name END
  AS value FROM users"""


def _legacy_lines(spark, d):
    u = V.users(spark, d)
    return u.select(F.col("user_id").alias("line_no"),
                    F.when(F.col("active"), F.concat(F.lit(" "), "name", F.lit(","), "email", F.lit(",legacy ")))
                    .otherwise(F.col("name")).alias("value"))


@query("parse_legacy_csv", W(f"""SELECT line_no, string_split(trim(value), ',')[1] AS name,
  string_split(trim(value), ',')[2] AS email FROM ({LEGACY_SQL}) WHERE len(string_split(trim(value), ',')) >= 2""",
                             "users"))
def q_parse_legacy_csv(spark, d):
    return U.parse_legacy_csv(_legacy_lines(spark, d), order="line_no")


@query("migrate_columns", W("""SELECT user_id, name, md5(email) AS password_hash, email FROM users""", "users"))
def q_migrate_columns(spark, d):
    u = V.users(spark, d).select("user_id", F.col("name").alias("username"), F.md5("email").alias("pass"), "email")
    return U.migrate_columns(u)


@query("import_users", W(f"""WITH legacy AS (
  SELECT line_no, string_split(trim(value), ',')[1] AS name, string_split(trim(value), ',')[2] AS email
  FROM ({LEGACY_SQL}) WHERE len(string_split(trim(value), ',')) >= 2),
existing AS (SELECT substr(md5(email), 1, 8) AS user_id, name, email, active FROM users WHERE nation < 12),
allrows AS (
  SELECT user_id, name, email, active, 0 AS src, NULL::BIGINT AS ord FROM existing
  UNION ALL SELECT substr(md5(email), 1, 8), name, email, true, 1, line_no FROM legacy)
SELECT user_id, name, email, active, (SELECT count(*) FROM legacy) AS imported FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY src DESC, ord DESC NULLS LAST) AS rn FROM allrows)
WHERE rn = 1""", "users"))
def q_import_users(spark, d):
    u = V.users(spark, d)
    existing = u.where(F.col("nation") < 12).select(T.short_hash_id("email").alias("user_id"), "name", "email",
                                                    "active")
    legacy = U.parse_legacy_csv(_legacy_lines(spark, d), order="line_no")
    users, seen = U.import_users(existing, legacy, "line_no")
    users = materialize(users, "users")
    return users.withColumn("imported", F.lit(U.imported(seen)).cast("long"))
