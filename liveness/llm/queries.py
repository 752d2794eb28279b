"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .decontamination import contamination
from .divergence import source_divergence
from .exact_dedup import exact_duplicates
from .html_text import extract_main_text
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .pii import personal_data
from .quality import quality
from .secrets import PLACEHOLDER, secret_scan
from .simhash import simhash_groups
from .spelling import spelling_variants
from .toxicity import toxicity
from .warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


#: Lower-cases A-Z only, as the contracts ask.
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op10_exact_dedup", f"""WITH d AS (SELECT doc_id, {_FOLD.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)""")
def op10(spark, d):
    return exact_duplicates(table(spark, d, "documents"))


#: Words of a text after lower-casing: runs of digits, letters and non-ASCII characters.
_ALNUM = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP9 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM.format(_FOLD.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format(_FOLD.format("coalesce(text, '')"))} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, w[i:i + least(10, len(w)) - 1] AS k
        FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT rid, i, size, w[i:i + size - 1] AS k FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(i)),
occ AS (SELECT rid, i, win.size, item_id FROM dw JOIN win ON dw.k = win.k AND dw.size = win.size),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + size)) AS u(p) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items,
              sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM occ GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)"""


@query("op9_benchmark_decontamination", _OP9)
def op9(spark, d):
    found = contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.drop("hit_starts", "hit_ends")


_OP2 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, sh FROM (SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w]
  ELSE list_transform(range(1, len(w)), lambda i: w[i:i + 1]) END) AS sh FROM d)),
n AS (SELECT rid, count(*) AS n, list(sh ORDER BY sh) AS shingles FROM s GROUP BY rid),
met AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY ALL),
link AS (SELECT x, y FROM met JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT rid, rid AS other FROM d UNION SELECT reach.rid, sides.y FROM reach JOIN sides ON sides.x = reach.other),
comp AS (SELECT reach.rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.other GROUP BY reach.rid),
class AS (SELECT shingles, min(doc_id) AS class_id FROM n JOIN d USING (rid) GROUP BY shingles)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept, coalesce(class_id, doc_id) AS class_id
FROM d JOIN comp USING (rid) LEFT JOIN n USING (rid) LEFT JOIN class USING (shingles)"""


@query("op2_minhash_near_dedup", _OP2)
def op2(spark, d):
    return near_duplicates(table(spark, d, "documents"), width=2)


@query("op4_mix_sources")
def op4(spark, d):
    return mix_sources(table(spark, d, "documents"))


#: Base32 of a SHA-1 in hexadecimal: five bits at a time, from the two digits that hold them.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((CAST('0x' || substr({0}, (5 * i) // 4 + 1, 2) AS INTEGER) >> (3 - (5 * i) % 4)) & 31), 1)), '')"""

_OP7 = f"""WITH p AS (SELECT page_id, regexp_replace(url, '[\\x00-\\x20\\x7F]', '%20', 'g') AS url, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, url, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CAST(strlen(p.h) AS BIGINT) AS payload_bytes, {_BASE32.format("sha1(p.h)")} AS payload_digest,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f ON p.h = f.h"""


@query("op7_warc_archive", _OP7)
def op7(spark, d):
    return round_trip(table(spark, d, "pages"))


@query("op8_personal_data")
def op8(spark, d):
    found = personal_data(table(spark, d, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_all")


def _matches_sql(pattern: str, kind: str, group: int = 0, keep: str = "true") -> str:
    """(rid, kind, start, from, end, value) of a pattern's matches, by the lengths of the texts between them."""
    return f"""SELECT rid, '{kind}' AS kind, ends[i] - len(m[i]) AS start, ends[i] - len(v[i]) AS "from", ends[i] AS "end", v[i] AS value
FROM (SELECT rid, m, v, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(b[1:i], lambda x: len(x)))
        + list_sum(list_transform(m[1:i], lambda x: len(x)))) AS ends
      FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v,
                   string_split_regex(t, '{pattern}') AS b FROM d WHERE regexp_matches(t, '{pattern}'))),
     unnest(range(1, len(m) + 1)) AS u(i) WHERE {keep}"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + ")[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?([A-Za-z0-9+/_.=-]+)"
_TEXT_OF = """array_to_string(list_transform(list_sort(list({{'s': CAST("start" AS INTEGER), 'k': list_position(['assign', 'access', 'hex', 'copied', 'live'], kind),
  'e': CAST("end" AS INTEGER), 'n': kind}}){0}), lambda x: x.n || ':' || x.s || ':' || x.e), ',')"""

_OP1 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner,
  coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
base AS ({_matches_sql(_ASSIGN, 'assign', 2, 'len(v[i]) >= 12')} UNION ALL {_matches_sql('AKIA[A-Z0-9]{14,}', 'access')}
  UNION ALL {_matches_sql('[0-9a-f]{16,}', 'hex')}),
bare AS ({_matches_sql('[A-Za-z0-9+/_.=-]{20,}', 'bare', 0, "regexp_full_match(m[i], '[A-Za-z0-9+/_-]+')")}),
cand AS (SELECT DISTINCT rid, "from", "end", value, owner, repository
  FROM (SELECT * FROM base UNION ALL SELECT * FROM bare WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')) JOIN d USING (rid)),
held AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM cand GROUP BY value),
more AS (SELECT rid, CASE WHEN owners >= 3 THEN 'copied' ELSE 'live' END AS kind, "from" AS "start", "end", owners, repositories
  FROM cand JOIN held USING (value)
  WHERE owners >= 3 OR owners = 1 AND repositories <= 2 AND len(value) >= 12 AND len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]')
    AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '{PLACEHOLDER}')),
every AS (SELECT rid, kind, "start", "end" FROM base UNION ALL SELECT rid, kind, "start", "end" FROM more),
told AS (SELECT rid, string_agg(kind || ':' || "start" || ':' || "end" || ':' || owners || ':' || repositories, ',' ORDER BY "start", kind, "end") AS held
  FROM more GROUP BY rid),
spans AS (SELECT rid, {_TEXT_OF.format("")} AS spans, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'copied') AS n_copied, count(*) FILTER (kind = 'live') AS n_live FROM every GROUP BY rid),
plain AS (SELECT rid, {_TEXT_OF.format("")} AS base FROM base GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live,
  coalesce(held, '') AS held FROM d LEFT JOIN spans USING (rid) LEFT JOIN plain USING (rid) LEFT JOIN told USING (rid)"""


@query("op1_secret_scan", _OP1)
def op1(spark, d):
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    found = secret_scan(table(spark, d, "documents"), owner="source", repository=repository)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_copied", "n_live", "held")


@query("op3_html_main_text")
def op3(spark, d):
    return extract_main_text(table(spark, d, "pages"))


@query("op5_toxicity_crf")
def op5(spark, d):
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op6_quality_cotraining")
def op6(spark, d):
    return quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op11_simhash_near_dedup")
def op11(spark, d):
    return simhash_groups(table(spark, d, "documents"))


#: CRC-32 of a string's UTF-8 bytes, with the table of its polynomial computed by rule (``tab.t``).
_CRC = """xor(list_reduce(list_transform(range(strlen({0})), lambda i: CAST('0x' || substr(hex({0}), 2 * i + 1, 2) AS UBIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT))"""

_OP12 = f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8),
    lambda c, y: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, CAST(x AS UBIGINT))) AS t),
r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, c, CAST({_CRC.format("s")} AS BIGINT) AS h FROM (SELECT run, c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM r), tab),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
pat AS (SELECT word, substr(word, 1, i) || '*' || substr(word, i + 2) AS p FROM v, unnest(range(length(word))) AS u(i)),
less AS (SELECT DISTINCT word, substr(word, 1, i) || substr(word, i + 2) AS p FROM v, unnest(range(length(word))) AS u(i)),
near AS (SELECT a.word AS x, b.word AS y FROM pat a JOIN pat b ON a.p = b.p AND a.word <> b.word
  UNION SELECT less.word, v.word FROM less JOIN v ON less.p = v.word UNION SELECT v.word, less.word FROM less JOIN v ON less.p = v.word),
best AS (SELECT x AS word, count(*) AS n_near, arg_min(y, struct_pack(m := -n, y := y)) AS y, max(n) AS n_y FROM near JOIN v ON v.word = y GROUP BY x),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_y >= 2 * v.n THEN y END AS form, CASE WHEN n_y >= 2 * v.n THEN n_y END AS form_n
  FROM v LEFT JOIN best USING (word)),
path AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT path.word, f.word, f.form FROM path JOIN f ON f.word = path.next)
SELECT f.word, f.form, path.root, f.n, f.n_near, f.form_n FROM f JOIN path ON path.word = f.word AND path.next IS NULL"""


@query("op12_spelling_variants", _OP12)
def op12(spark, d):
    return spelling_variants(table(spark, d, "documents"))


_SHARE = "1 + (CAST(1000000000 AS HUGEINT) * ({0} + 5)) // ({1} + 5 * v)"

_OP13 = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, kept.n AS n_lang FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
share AS (SELECT lang, source, term, dense.n, {_SHARE.format("dense.n", "t.total")} AS p, {_SHARE.format("n_lang", "v.total")} AS q
  FROM dense JOIN (SELECT lang, source, sum(n) AS total FROM dense GROUP BY ALL) t USING (lang, source) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b USING (lang, term) GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query("op13_source_divergence", _OP13)
def op13(spark, d):
    return source_divergence(table(spark, d, "documents"))
