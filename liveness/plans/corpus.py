"""A Python source corpus that Spark derives from the driver tables.

One module per order; one block per line item, named after the item's part (names
repeat corpus-wide, so bare-name reference counting matters). Each block calls the
part of the previous line of the same order (the first calls ``main``). The block's
shape depends on the item: returned items branch with boolean operators, accepted
items loop, others use a comprehension; open, heavily discounted items add a
``getattr`` call (dynamic invocation); untaxed items carry a decorator; first lines
of finished orders are classes. Urgent orders live under ``tests/``; the priority sets
the directory depth. Pending low-priority modules end with a syntax error.

Generation is plain column expressions plus one group-by on the order key. A module is
one order's items (13 at most at sf0.01, 17 at sf0.1; nothing bounds it but the table), so
it scales with the number of orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import default_parallelism, table
from .views import _cat_name

# line numbers repeat within an order; ordering by every column a block depends on makes
# the module text deterministic (rows tying on all of them produce identical blocks)
ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus",
              "l_discount", "l_tax"]

#: Line items that one task turns into modules and parses.
ROWS_PER_TASK = 50_000

PRIORITY_DIRS = {
    "1-URGENT": "tests/",
    "2-HIGH": "app/",
    "3-MEDIUM": "app/core/",
    "4-NOT SPECIFIED": "app/core/util/misc/",
    "5-LOW": "app/legacy/a/b/c/d/",
}


def corpus_blocks(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag",
        "l_linestatus", "l_discount", "l_tax")
    p = table(spark, d, "part").select("p_partkey", _cat_name().alias("name"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    w = Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER)
    # one exchange of the items on the order key serves the join with the orders, the window, the group-by and
    # the parser's tasks; the number of partitions grows with the rows (the count comes from file metadata)
    n = max(3 * default_parallelism(spark), -(-li.count() // ROWS_PER_TASK))
    x = (li.join(p, li.l_partkey == p.p_partkey).repartition(n, "l_orderkey")
         .join(o.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
         .withColumn("callee", F.coalesce(F.lag("name").over(w), F.lit("main"))))
    q = F.round(F.col("l_quantity")).cast("int").cast("string")
    stmt = (F.when(F.col("l_returnflag") == "R",
                   F.concat(F.lit("    if x and "), q, F.lit(" or x > "), q, F.lit(":\n        x = x - 1\n")))
            .when(F.col("l_returnflag") == "A",
                  F.concat(F.lit("    for i in range("), q, F.lit("):\n        x = x + i\n")))
            .otherwise(F.concat(F.lit("    x = [y for y in range("), q, F.lit(") if y]\n"))))
    dyn = F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") >= 0.08),
                 F.concat(F.lit('    getattr(x, "'), F.col("callee"), F.lit('")\n'))).otherwise(F.lit(""))
    deco = F.when(F.col("l_tax") == 0.0, F.concat(F.lit("@"), F.col("callee"), F.lit("\n"))).otherwise(F.lit(""))
    func = F.concat(deco, F.lit("def "), F.col("name"), F.lit("(x):\n"), stmt, dyn,
                    F.lit("    return "), F.col("callee"), F.lit("(x)\n"))
    klass = F.concat(F.lit("class "), F.col("name"), F.lit(":\n    def method_"),
                     F.col("l_linenumber").cast("string"), F.lit("(self):\n        return "),
                     F.col("callee"), F.lit("(self)\n"))
    block = F.when((F.col("l_linenumber") == 1) & (F.col("o_orderstatus") == "F"), klass).otherwise(func)
    return x.select("l_orderkey", "o_orderstatus", "o_orderpriority", *ITEM_ORDER, block.alias("block"))


def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """files(path, rel_path, language, content STRING). Orders are joined once; window and
    group-by share the one exchange on the order key."""
    blocks = corpus_blocks(spark, d)
    body = blocks.groupBy("l_orderkey", "o_orderstatus", "o_orderpriority").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct(*ITEM_ORDER, "block"))).getField("block"),
                     "\n").alias("body"))
    dirs = F.create_map(*[x for k, v in PRIORITY_DIRS.items() for x in (F.lit(k), F.lit(v))])
    prefix = F.element_at(dirs, F.col("o_orderpriority"))
    fname = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("test_o")).otherwise(F.lit("o"))
    rel = F.concat(prefix, fname, F.col("l_orderkey").cast("string"), F.lit(".py"))
    broken = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    content = F.concat(F.lit('"""module '), F.col("l_orderkey").cast("string"), F.lit('"""\n\n'),
                       F.col("body"), F.when(broken, F.lit("\ndef broken(:\n")).otherwise(F.lit("")))
    return body.select(
        F.concat(F.lit("/corpus/"), rel).alias("path"), rel.alias("rel_path"),
        F.lit("python").alias("language"), content.alias("content"))


# ----------------------------------------------------------------------------- SQL
# The same corpus in DuckDB SQL, and what a correct parse of it must yield (entities
# with lines, complexity, dynamic flag and snippet; calls), recomputed from the tables.

_NAME_SQL = ("CASE WHEN p_type = 'SMALL' THEN '_' WHEN p_type = 'PROMO' THEN '__' ELSE '' END"
             " || replace(p_name, ' ', '_')")
_Q = "CAST(CAST(round(l_quantity) AS INTEGER) AS VARCHAR)"
_NL = "chr(10)"
_DIR_SQL = "CASE o_orderpriority " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_DIRS.items()) + " END"
_REL_SQL = (f"{_DIR_SQL} || CASE WHEN o_orderpriority = '1-URGENT' THEN 'test_o' ELSE 'o' END"
            " || CAST(o_orderkey AS VARCHAR) || '.py'")

CORPUS_SQL = {
    "corpus_items": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
        l_linestatus, l_discount, l_tax, o_orderstatus, o_orderpriority, {_REL_SQL} AS rel_path, {_NAME_SQL} AS name,
        COALESCE(lag({_NAME_SQL}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_discount, l_tax), 'main') AS callee,
        l_linenumber = 1 AND o_orderstatus = 'F' AS is_class,
        l_linestatus = 'O' AND l_discount >= 0.08 AS is_dyn, l_tax = 0.0 AS has_deco,
        o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AS broken
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "corpus_blocks": f"""SELECT *, CASE WHEN is_class THEN
          'class ' || name || ':' || {_NL} || '    def method_' || CAST(l_linenumber AS VARCHAR)
          || '(self):' || {_NL} || '        return ' || callee || '(self)' || {_NL}
        ELSE
          CASE WHEN has_deco THEN '@' || callee || {_NL} ELSE '' END || 'def ' || name || '(x):' || {_NL}
          || CASE WHEN l_returnflag = 'R' THEN '    if x and ' || {_Q} || ' or x > ' || {_Q} || ':' || {_NL}
                  || '        x = x - 1' || {_NL}
                  WHEN l_returnflag = 'A' THEN '    for i in range(' || {_Q} || '):' || {_NL} || '        x = x + i' || {_NL}
                  ELSE '    x = [y for y in range(' || {_Q} || ') if y]' || {_NL} END
          || CASE WHEN is_dyn THEN '    getattr(x, "' || callee || '")' || {_NL} ELSE '' END
          || '    return ' || callee || '(x)' || {_NL} END AS block
        FROM corpus_items""",
    "corpus_files": f"""SELECT '/corpus/' || rel_path AS path, rel_path, 'python' AS language,
        '\"\"\"module ' || CAST(l_orderkey AS VARCHAR) || '\"\"\"' || {_NL} || {_NL} || body
        || CASE WHEN broken THEN {_NL} || 'def broken(:' || {_NL} ELSE '' END AS content
        FROM (SELECT l_orderkey, rel_path, broken, string_agg(block, {_NL} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_discount, l_tax) AS body
              FROM corpus_blocks GROUP BY l_orderkey, rel_path, broken)""",
    # first line of each block: 3 + sum of (lines + 1) of the blocks before it
    "corpus_placed": f"""SELECT *, 3 + COALESCE(sum(n_lines + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_discount, l_tax
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_start
        FROM (SELECT *, length(block) - length(replace(block, {_NL}, '')) AS n_lines FROM corpus_blocks)""",
    "corpus_entities": f"""
        SELECT rel_path AS path, name, 'class' AS entity_type, CAST(block_start AS INTEGER) AS start_line,
          CAST(block_start + 2 AS INTEGER) AS end_line, 1 AS cyclomatic_complexity, 0 AS dynamic_call_risk,
          'class ' || name || ':' AS snippet
        FROM corpus_placed WHERE is_class AND NOT broken
        UNION ALL
        SELECT rel_path, 'method_' || CAST(l_linenumber AS VARCHAR), 'function', CAST(block_start + 1 AS INTEGER),
          CAST(block_start + 2 AS INTEGER), 1, 0,
          'def method_' || CAST(l_linenumber AS VARCHAR) || '(self):' || {_NL} || '        return ' || callee || '(self)'
        FROM corpus_placed WHERE is_class AND NOT broken
        UNION ALL
        SELECT rel_path, name, 'function',
          CAST(block_start + CASE WHEN has_deco THEN 1 ELSE 0 END AS INTEGER),
          CAST(block_start + n_lines - 1 AS INTEGER),
          CASE l_returnflag WHEN 'R' THEN 4 ELSE 2 END, CASE WHEN is_dyn THEN 1 ELSE 0 END,
          substr(block, CASE WHEN has_deco THEN strpos(block, {_NL}) + 1 ELSE 1 END,
                 length(block) - 1 - CASE WHEN has_deco THEN strpos(block, {_NL}) ELSE 0 END)
        FROM corpus_placed WHERE NOT is_class AND NOT broken""",
    "corpus_calls": f"""
        SELECT rel_path AS path, callee, o_orderpriority = '1-URGENT' AS in_test_file FROM corpus_items WHERE NOT broken
        UNION ALL
        SELECT rel_path, 'range', o_orderpriority = '1-URGENT' FROM corpus_items
          WHERE NOT broken AND NOT is_class AND l_returnflag <> 'R'
        UNION ALL
        SELECT rel_path, 'getattr', o_orderpriority = '1-URGENT' FROM corpus_items
          WHERE NOT broken AND NOT is_class AND is_dyn""",
}

CORPUS_DEPS = {
    "corpus_blocks": ["corpus_items"],
    "corpus_files": ["corpus_blocks"],
    "corpus_placed": ["corpus_blocks"],
    "corpus_entities": ["corpus_placed"],
    "corpus_calls": ["corpus_items"],
}
