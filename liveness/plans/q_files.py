"""Checked queries over file trees: documents as a source tree, and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import source_text as ST
from ..sources import files as FS
from . import views as V
from .corpus import corpus_files
from ..session import table
from .registry import query

W = V.with_views
EXT_SQL = r"lower(regexp_extract(path, '\.([^./]*)$', 1))"


def _docs(spark, d):
    return V.doc_files(spark, d)


@query("detect_language", W("SELECT doc_id, path, language FROM doc_files", "doc_files"))
def q_detect_language(spark, d):
    return _docs(spark, d).select("doc_id", "path", "language")


@query("exclude_dirs", W(f"""SELECT doc_id, path FROM doc_files
WHERE NOT list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1),
                       {["'" + n + "'" for n in K.EXCLUDED_DIRS]!s})""".replace('"', ""), "doc_files"))
def q_exclude_dirs(spark, d):
    return FS.exclude_dirs(_docs(spark, d), "path").select("doc_id", "path")


@query("cap_per_extension", W(f"""SELECT doc_id, path FROM (
  SELECT *, row_number() OVER (PARTITION BY {EXT_SQL} ORDER BY path) AS rn FROM doc_files)
WHERE rn <= {K.MAX_FILES_PER_EXTENSION}""", "doc_files"))
def q_cap_per_extension(spark, d):
    return FS.cap_per_extension(_docs(spark, d), K.MAX_FILES_PER_EXTENSION, path="path").select("doc_id", "path")


@query("count_source_files", W(f"SELECT count(*) AS source_files FROM doc_files WHERE {EXT_SQL} = 'py'",
                               "doc_files"))
def q_count_source_files(spark, d):
    return FS.count_source_files(_docs(spark, d), "py", "path")


@query("union_file_sets", W(f"""SELECT doc_id, path, {EXT_SQL} AS ext FROM doc_files WHERE {EXT_SQL} = 'py'
UNION ALL SELECT doc_id, path, {EXT_SQL} FROM doc_files WHERE {EXT_SQL} IN ('js', 'ts', 'tsx')""", "doc_files"))
def q_union_file_sets(spark, d):
    docs = _docs(spark, d).select("doc_id", "path", FS.extension("path").alias("ext"))
    sets = [docs.where(F.col("ext") == e) for e in ("py", "js", "ts", "tsx")]
    return FS.union_file_sets(*sets)


# ranges derived per document: lines 2-3 and 3-5 (overlapping) and the last two lines
# with an end past the text (clipped)
RANGES_SQL = """SELECT path, content, len(string_split(content, chr(10))) AS n FROM doc_files"""


def _ranges(spark, d):
    docs = _docs(spark, d).withColumn("_n", F.size(F.split("content", "\n", -1)))
    r = docs.select("path", F.explode(F.array(
        F.struct(F.lit(2).alias("start_line"), F.lit(3).alias("end_line")),
        F.struct(F.lit(3).alias("start_line"), F.lit(5).alias("end_line")),
        F.struct((F.col("_n") - 1).alias("start_line"), (F.col("_n") + 3).alias("end_line")))).alias("r"))
    return docs, r.select("path", "r.start_line", "r.end_line")


def _in_sql(extra: int) -> str:
    return (f"((i >= 2 AND i <= least({3 + extra}, n)) OR (i >= 3 AND i <= least({5 + extra}, n))"
            f" OR (i >= n - 1 AND i <= least(n + {3 + extra}, n)))")


@query("remove_line_ranges", W(f"""SELECT path,
  array_to_string(list_filter(string_split(content, chr(10)), lambda x, i: NOT {_in_sql(0)}), chr(10)) AS new_content,
  CAST(n - len(list_filter(string_split(content, chr(10)), lambda x, i: NOT {_in_sql(0)})) AS INTEGER) AS removed_lines
FROM ({RANGES_SQL})""", "doc_files"))
def q_remove_line_ranges(spark, d):
    docs, r = _ranges(spark, d)
    return ST.remove_line_ranges(docs.select("path", "content"), r)


@query("remove_line_ranges_editor", W(f"""SELECT path,
  array_to_string(CASE WHEN (n >= n - 1 AND n <= least(n + 4, n))
                         AND len(list_filter(string_split(content, chr(10)), lambda x, i: NOT {_in_sql(1)})) > 0
    THEN list_append(list_filter(string_split(content, chr(10)), lambda x, i: NOT {_in_sql(1)}), '')
    ELSE list_filter(string_split(content, chr(10)), lambda x, i: NOT {_in_sql(1)}) END, chr(10)) AS new_content,
  CAST(n - len(list_filter(string_split(content, chr(10)), lambda x, i: NOT {_in_sql(1)})) AS INTEGER) AS removed_lines
FROM ({RANGES_SQL})""", "doc_files"))
def q_remove_line_ranges_editor(spark, d):
    docs, r = _ranges(spark, d)
    return ST.remove_line_ranges(docs.select("path", "content"), r, extra_lines=1)


@query("removal_rows", W("""SELECT CAST(0 AS BIGINT) AS entity_id, path AS file_name,
  CASE WHEN least(e, n) >= greatest(s, 1)
       THEN array_to_string(list_slice(string_split(content, chr(10)), greatest(s, 1), least(e, n)), chr(10))
       ELSE '' END AS removed_code,
  CAST(CASE WHEN s = 2 THEN 0.6 WHEN s = 3 THEN 0.8 ELSE 0.9 END AS DOUBLE) AS confidence_score
FROM (SELECT d.*, r.s, r.e FROM (""" + RANGES_SQL + """) d,
      (SELECT unnest([2, 3, -1]) AS s0, unnest([3, 5, 3]) AS e0) k0,
      LATERAL (SELECT CASE WHEN k0.s0 = -1 THEN d.n - 1 ELSE k0.s0 END AS s,
                      CASE WHEN k0.s0 = -1 THEN d.n + k0.e0 ELSE k0.e0 END AS e) r)""", "doc_files"))
def q_removal_rows(spark, d):
    docs, r = _ranges(spark, d)
    r = r.withColumn("confidence", F.when(F.col("start_line") == 2, 0.6)
                     .when(F.col("start_line") == 3, 0.8).otherwise(0.9))
    return ST.removal_rows(docs.select("path", "content"), r)


CORPUS_LINES_SQL = """SELECT rel_path, unnest(string_split(content, chr(10))) AS line,
  unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM corpus_files"""


def _regex_sql(dedupe: bool) -> str:
    parts = []
    for k, (pat, kind) in enumerate(ST.SYMBOL_PATTERNS["python"]):
        parts.append(f"""SELECT rel_path, regexp_extract(line, '{pat}', 1) AS name, '{kind}' AS kind,
  {k} AS pattern_no, CAST(line_no AS INTEGER) AS start_line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS snippet FROM lines""")
    body = " UNION ALL ".join(parts)
    sql = f"WITH lines AS ({CORPUS_LINES_SQL}), m AS ({body}) SELECT * FROM m WHERE length(name) >= 2"
    if dedupe:
        sql = f"""WITH lines AS ({CORPUS_LINES_SQL}), m AS ({body})
SELECT rel_path, name, kind, pattern_no, start_line, snippet FROM (
  SELECT *, row_number() OVER (PARTITION BY rel_path, name ORDER BY pattern_no, start_line) AS rn
  FROM m WHERE length(name) >= 2) WHERE rn = 1"""
    return W(sql, "corpus_files")


@query("regex_symbols", _regex_sql(False))
def q_regex_symbols(spark, d):
    return ST.regex_symbols(corpus_files(spark, d), dedupe=False)


@query("first_seen_symbols", _regex_sql(True))
def q_first_seen_symbols(spark, d):
    return ST.regex_symbols(corpus_files(spark, d), dedupe=True)


# Script sources from the parts: a line per shape that the JavaScript and TypeScript patterns
# know, indented or not, with tabs and carriage returns around it.
SCRIPT_LINES = ["export async function {n}(a) {{", "function {n}<T>(a) {{", "export class {n} extends B {{", "\texport class x{n}\r",
                "export const {n} = async (a) => 1", "const {n}: Kind = (b) => 2\r", "const {n} = async x => y =>", "const {n} = x => 3",
                "  private async {n}(q) {{", " static  {n}(q) {{\t", "def {n}(x):", "class a"]
SCRIPT_LANGUAGES = ["javascript", "typescript", "javascriptreact", "typescriptreact", "go"]


def _scripts(spark, d):
    p = table(spark, d, "part")
    name = F.replace(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("#"), F.lit(""))
    lines = [F.concat(*[F.col("n") if i % 2 else F.lit(t) for i, t in enumerate(_pieces(x))]) for x in SCRIPT_LINES]
    lang = F.element_at(F.array(*[F.lit(x) for x in SCRIPT_LANGUAGES]), (F.col("p_size") % len(SCRIPT_LANGUAGES) + 1).cast("int"))
    return (p.withColumn("n", name).select(
        F.concat(F.lit("web/part_"), F.col("p_partkey").cast("string")).alias("rel_path"), lang.alias("language"),
        F.concat_ws("\n", *[F.when((F.col("p_partkey") + k) % 3 != 0, x) for k, x in enumerate(lines)]).alias("content")))


def _pieces(line: str) -> list[str]:
    """Literal parts and name slots of a line in turn."""
    left, _, right = line.format(n="\0").partition("\0")
    return [left, "n", right] if "\0" in line.format(n="\0") else [left]


def _scripts_sql() -> str:
    def text(x):
        return " || ".join("n" if i % 2 else "'" + t.replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '") + "'"
                           for i, t in enumerate(_pieces(x)))
    rows = " UNION ALL ".join(f"SELECT k, lang, {i} AS i, {text(x)} AS line FROM parts WHERE (k + {i}) % 3 <> 0"
                              for i, x in enumerate(SCRIPT_LINES))
    found = []
    for lang, patterns in ST.SYMBOL_PATTERNS.items():
        for no, (pat, kind) in enumerate(patterns):
            found.append(f"""SELECT rel_path, regexp_extract(line, '{pat}', 1) AS name, '{kind}' AS kind, {no} AS pattern_no,
  start_line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS snippet FROM lines WHERE base = '{lang}'""")
    langs = "[" + ", ".join(f"'{x}'" for x in SCRIPT_LANGUAGES) + "]"
    return f"""WITH parts AS (SELECT p_partkey AS k, {langs}[p_size % {len(SCRIPT_LANGUAGES)} + 1] AS lang,
  replace(replace(p_name, ' ', '_'), '#', '') AS n FROM part),
lines AS (SELECT 'web/part_' || CAST(k AS VARCHAR) AS rel_path, line,
  CASE WHEN replace(lang, 'react', '') IN ('python', 'typescript') THEN replace(lang, 'react', '') ELSE 'javascript' END AS base,
  CAST(row_number() OVER (PARTITION BY k ORDER BY i) AS INTEGER) AS start_line FROM ({rows}))
SELECT * FROM ({' UNION ALL '.join(found)}) WHERE length(name) >= 2"""


@query("regex_symbols_scripts", _scripts_sql())
def q_regex_symbols_scripts(spark, d):
    """The JavaScript and TypeScript patterns, by language and for languages without their own."""
    return ST.regex_symbols(_scripts(spark, d), dedupe=False)
