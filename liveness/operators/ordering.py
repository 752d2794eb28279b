"""Row-order operators: latest per key, de-duplication, pagination, top-N, sorting.

Skew rule: one key may hold a large share of all rows, so no operator here ranks a
whole group inside one task when it only needs a few rows of it.

* first / latest row per key: ``min_by`` / ``max_by`` aggregates - hash aggregation
  with a map-side partial step, so a hot key is reduced before the shuffle;
* top-n per group: two phases - rank inside (group, hash bucket) and keep n, then
  rank the at most n x buckets survivors of each group - exact, because every row of
  a group's top n is in the top n of its bucket;
* global newest-n: ``orderBy().limit()``, planned as TakeOrderedAndProject.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .. import constants as K

SALT_BUCKETS = 64


def _order(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _pick(df: DataFrame, keys: list[str], order_struct: Column, agg) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(agg(row, order_struct).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_per_key(df: DataFrame, keys: list[str], order_desc: list[str]) -> DataFrame:
    """Last write wins: the row with the greatest (order_desc...) per key."""
    return _pick(df, keys, F.struct(*[F.col(c) for c in order_desc]), F.max_by)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key by the given (ascending) order."""
    return _pick(df, keys, F.struct(*[F.col(c) for c in order]), F.min_by)


def top_n_per_group(df: DataFrame, group: list[str], order: list, n: int, rank_col: str = "rank",
                    salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` with their 1-based rank."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*_order(order))
    local = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
             .where(F.col("_r1") <= n).drop("_r1"))
    w2 = Window.partitionBy(*group).orderBy(*_order(order))
    return (local.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= n)
            .drop("_salt"))


def newest(df: DataFrame, n: int, ts: str = "timestamp", tie: str = "id",
           where: Column | None = None) -> DataFrame:
    """Newest ``n`` rows by timestamp, ties broken by id (both descending)."""
    if where is not None:
        df = df.where(where)
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def newest_per_group(df: DataFrame, group: str, n: int, ts: str = "timestamp",
                     tie: str = "id") -> DataFrame:
    return top_n_per_group(df, [group], [F.col(ts).desc(), F.col(tie).desc()], n)


def recent_sessions(sessions: DataFrame, project: str | None = None,
                    n: int = K.RECENT_SESSIONS) -> DataFrame:
    """Sessions of a project, newest ``n``; without a project, newest ``n`` of each."""
    if project is not None:
        return newest(sessions, n, where=F.col("project_path") == project)
    return newest_per_group(sessions, "project_path", n)


def recent_removals(removals: DataFrame, n: int = K.RECENT_REMOVALS) -> DataFrame:
    return newest(removals, n)


def recent_chat(chats: DataFrame, n: int = K.RECENT_CHATS) -> DataFrame:
    return newest(chats, n)


#: Pages up to this row come from a top-n; deeper ones from an index.
SHALLOW = 10_000


@dataclass
class PageIndex:
    """A table written in order, in ranges, with the number of rows before each range."""
    spark: SparkSession
    path: str
    schema: StructType
    starts: list[int]  # rows before each range, and all rows last

    def page(self, page: int, per_page: int = 10) -> DataFrame:
        """The rows of one page, in order. Only the ranges that hold some of them are read."""
        lo = max((page - 1) * per_page, 0)
        hi = min(lo + per_page, self.starts[-1])
        if lo >= hi:
            return self.spark.createDataFrame([], self.schema)
        first, last = bisect_right(self.starts, lo) - 1, bisect_left(self.starts, hi) - 1
        held = [f"{self.path}/__pi_range={k}" for k in range(first, last + 1) if self.starts[k] < self.starts[k + 1]]
        fields = [*self.schema.fields, StructField("__pi_row", LongType()), StructField("__pi_range", IntegerType())]
        rows = self.spark.read.schema(StructType(fields)).option("basePath", self.path).parquet(*held)
        at = F.element_at(F.array(*[F.lit(s).cast("long") for s in self.starts[first:last + 1]]), F.col("__pi_range") - first + 1)
        # per range, so that the reader can skip its row groups
        inside = reduce(lambda x, y: x | y, [(F.col("__pi_range") == k) & (F.col("__pi_row") >= lo - self.starts[k])
                                             & (F.col("__pi_row") < hi - self.starts[k]) for k in range(first, last + 1)])
        return rows.where(inside).orderBy(at + F.col("__pi_row")).select(*self.schema.names)


def page_index(df: DataFrame, order: list, partitions: int | None = None) -> PageIndex:
    """Sort a table once and write it in ranges of ``order`` (a total order, else rows that tie are in any
    order), so that any page of it can be read alone. The driver holds one number per range."""
    from ..session import new_stage_path
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_stage_path(spark, "pages")
    row = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    (df.repartitionByRange(n, *_order(order)).withColumn("__pi_range", F.spark_partition_id())
     .sortWithinPartitions("__pi_range", *_order(order)).withColumn("__pi_row", row)
     .write.partitionBy("__pi_range").parquet(path))
    written = spark.read.schema(StructType([StructField("__pi_range", IntegerType())])).parquet(path)
    sizes = {r["__pi_range"]: r["count"] for r in written.groupBy("__pi_range").count().collect()}
    return PageIndex(spark, path, df.schema, [0, *accumulate(sizes.get(k, 0) for k in range(n))])


def paginate(df: DataFrame, order: list, page: int, per_page: int = 10,
             group: str | None = None) -> DataFrame:
    """Rows (page-1)*per_page ... of the ordered table (or of each group). For several pages of one
    table, or deep ones, make a ``page_index`` once."""
    start = (page - 1) * per_page
    if group is None:
        if start + per_page > SHALLOW:
            return page_index(df, order).page(page, per_page)
        return df.orderBy(*_order(order)).offset(start).limit(per_page)
    if start + per_page > SHALLOW:
        top = positions_within(df, group, _order(order), out="row_no").where(F.col("row_no") <= start + per_page)
    else:
        top = top_n_per_group(df, [group], order, start + per_page, rank_col="row_no")
    return top.where(F.col("row_no") > start)


def positions_within(df: DataFrame, group: str, order: list[Column], out: str = "pos",
                     partitions: int | None = None) -> DataFrame:
    """1-based position of each row within its group by ``order`` (which must be a
    total order inside the group), without ranking a large group in one task.

    Groups that hold a large share of the rows (``skew.heavy_keys``) are numbered by ranges; the others by a
    window, which moves a row once and writes none, and not at all where the rows lie by their group already.
    ``df`` is read once more for the sketch, of its group alone."""
    from .skew import heavy_keys
    window = Window.partitionBy(group).orderBy(*order)
    numbered = lambda rows: rows.withColumn(out, F.row_number().over(window))
    heavy = heavy_keys(df, group)
    if not heavy:
        return numbered(df)
    among = F.coalesce(F.col(group).isin([k for k in heavy if k is not None] or [None]), F.lit(False))
    if None in heavy:
        among = among | F.col(group).isNull()
    return numbered(df.where(~among)).unionByName(_positions_by_ranges(df.where(among), group, order, out, partitions))


def _positions_by_ranges(df: DataFrame, group: str, order: list[Column], out: str, partitions: int | None) -> DataFrame:
    """``positions_within`` for groups too large for a task.

    Rows are range-partitioned on (group, order) - a hot group is spread over several
    ordered partitions - and sorted within partitions; the row's index inside its
    partition comes from ``monotonically_increasing_id``. A small table of
    (partition, group) counts gives each group's offset in every partition (a window
    over at most #partitions rows per group); position = offset + local index.

    The id-stamped rows are written once to the shared stage folder: the counts and
    the join back must see the same partition ids, which two recomputations (with AQE
    coalescing each shuffle read on its own) would not guarantee."""
    from ..session import materialize
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    x = materialize(ranged.withColumn("__pw_pid", F.spark_partition_id())
                    .withColumn("__pw_li", F.monotonically_increasing_id()
                                - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "positions")
    stats = x.groupBy(F.col("__pw_pid").alias("__pw_of"), F.col(group).alias("__pw_group")).agg(
        F.min("__pw_li").alias("__pw_first"), F.count(F.lit(1)).alias("__pw_n"))
    before = Window.partitionBy("__pw_group").orderBy("__pw_of").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("__pw_off", F.coalesce(F.sum("__pw_n").over(before), F.lit(0)))
    # heavy groups are few: at most as many rows as groups and partitions
    return (x.join(F.broadcast(stats), (F.col("__pw_pid") == F.col("__pw_of")) & F.col(group).eqNullSafe(F.col("__pw_group")))
            .withColumn(out, (F.col("__pw_off") + F.col("__pw_li") - F.col("__pw_first") + 1).cast("int"))
            .drop("__pw_pid", "__pw_li", "__pw_of", "__pw_group", "__pw_first", "__pw_n", "__pw_off"))


def running_sums(df: DataFrame, order: list[Column], cols: list[str], partitions: int | None = None) -> DataFrame:
    """Adds ``cum_<c>`` (sum of ``c`` up to and including the row, by ``order``) and ``all_<c>``
    for each column, without one task that sees all rows: rows are range-partitioned and
    summed within partitions, and only the partitions' totals are put in sequence."""
    from ..session import materialize
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("__rs_pid", F.spark_partition_id()), "running")
    totals = x.groupBy("__rs_pid").agg(*[F.sum(c).alias(c) for c in cols])
    before = Window.orderBy("__rs_pid").rowsBetween(Window.unboundedPreceding, -1)   # at most n rows
    every = Window.partitionBy(F.lit(1))
    totals = totals.select("__rs_pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__rs_{c}") for c in cols],
                           *[F.sum(c).over(every).alias(f"all_{c}") for c in cols])
    inside = Window.partitionBy("__rs_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (x.select("*", *[F.sum(c).over(inside).alias(f"cum_{c}") for c in cols]).join(totals, "__rs_pid")
            .select(*df.columns, *[(F.col(f"cum_{c}") + F.col(f"__rs_{c}")).alias(f"cum_{c}") for c in cols],
                    *[f"all_{c}" for c in cols]))


def sort_results(results: DataFrame, mode: str = "confidence", file_col: str = "file_name",
                 name: str = "name", line: str = "start_line", conf: str = "confidence",
                 tie: str = "entity_id") -> DataFrame:
    """Dashboard order within each file: confidence desc / name asc / line asc.

    Adds ``sort_pos`` (1-based position within the file) so the order survives a
    distributed write; name order is binary (code point), not locale-aware. Positions come
    from ``positions_within``, so a file with a large share of all rows is not ranked in
    one task."""
    keys = {
        "confidence": [F.col(conf).desc()],
        "name": [F.col(name).asc()],
        "line": [F.col(line).asc()],
    }[mode]
    return positions_within(results, file_col, [*keys, F.col(tie).asc()], out="sort_pos")


def top_suspects(results: DataFrame, n: int = K.TOP_SUSPECTS, file_col: str | None = "file_name",
                 conf: str = "confidence", tie: str = "entity_id") -> DataFrame:
    """Confidence > 0.5, highest first, top ``n`` (per file when ``file_col`` is set)."""
    cand = results.where(F.col(conf) > K.PREDICT_DEAD_ABOVE)
    if file_col is None:
        return cand.orderBy(F.col(conf).desc(), F.col(tie).asc()).limit(n)
    return top_n_per_group(cand, [file_col], [F.col(conf).desc(), F.col(tie).asc()], n)
