"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be copied target / source_size times. The whole part is
taken as it is; the fraction is rounded by the pivotal method: two fractional documents
pass words between each other, up or down by chance, until one is whole. That keeps every
expectation and, in words, the sum. Blocks of documents are rounded to one residual each,
the residuals form blocks of the next level, and so on up a tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_count, shuffle_partitions, stage

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of a block of the reduction tree, on average (blocks are dealt by hash).
BLOCK = 256
#: Rows that agree in source, id and size are numbered in sequences of this many.
TWINS = 1024


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use).getItem(0)


# ------------------------------------------------------------------ targets

def _ranked(sources: DataFrame) -> DataFrame:
    """0-based ``rank`` by source name, null last: range partitions are sorted apart, and
    only their row counts are put in sequence."""
    n = shuffle_partitions(sources.sparkSession)
    at = F.spark_partition_id()
    placed = stage(sources.repartitionByRange(n, F.col("source").asc_nulls_last())
                   .sortWithinPartitions(F.col("source").asc_nulls_last())
                   .withColumn("part", at)
                   .withColumn("local", F.monotonically_increasing_id() - F.shiftleft(at.cast("long"), 33)), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over at most n rows
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, "part").withColumn("rank", F.col("offset") + F.col("local")).drop("part", "local", "offset")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (key, source, size) summed per source: key, source, rank, n, source_size, target.

    Sources in order of their name by code point, null last, have the ``weights`` in turn and
    share all words by them; a target stops at ``most`` times its source's size, and what is
    above is shared again by weight until no target is above."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    found = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    found = stage(_ranked(found).withColumn("weight", weight), "sources")
    limit = F.col("source_size") * most
    words, total = found.agg(F.sum("source_size"), F.sum("weight")).first()
    level, last = (words / total if words else 0.0), None
    while level != last:  # words for a weight of 1; grows until no further source reaches its limit
        full = F.col("weight") * level > limit
        used, held = found.agg(F.sum(F.when(full, limit)), F.sum(F.when(full, F.col("weight")))).first()
        last, free = level, (total or 0) - (held or 0)
        if used is not None and free > 0:
            level = max(level, (words - used) / free)
    return found.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), limit.cast("double"))).drop("weight")


# ------------------------------------------------------------------ pivotal rounding

def _step(carry: Column, item: Column) -> Column:
    """Two fractional documents pass words until one is whole: struct(whole one, other one)."""
    part = lambda x, p: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["twin"].alias("twin"), p.alias("p"), x["u"].alias("u"))
    room = lambda x: (1 - x["p"]) * x["size"]
    held = lambda x: x["p"] * x["size"]

    def moved(d: Column) -> Column:
        rise = item["u"] * (d["rise"] + d["fall"]) < d["fall"]  # the carried one rises
        a = (F.when(rise, F.when(room(carry) <= held(item), 1.0).otherwise(carry["p"] + d["rise"] / carry["size"]))
             .otherwise(F.when(held(carry) <= room(item), 0.0).otherwise(carry["p"] - d["fall"] / carry["size"])))
        b = (F.when(rise, F.when(held(item) <= room(carry), 0.0).otherwise(item["p"] - d["rise"] / item["size"]))
             .otherwise(F.when(room(item) <= held(carry), 1.0).otherwise(item["p"] + d["fall"] / item["size"])))
        return F.struct(part(carry, a).alias("a"), part(item, b).alias("b"))

    def ordered(ab: Column) -> Column:
        first = (ab["a"]["p"] <= 0) | (ab["a"]["p"] >= 1)
        return F.struct(F.when(first, ab["a"]).otherwise(ab["b"]).alias("whole"),
                        F.when(first, ab["b"]).otherwise(ab["a"]).alias("other"))

    ways = F.struct(F.least(room(carry), held(item)).alias("rise"), F.least(held(carry), room(item)).alias("fall"))
    return _let(_let(ways, moved), ordered)


def _rounded(items: Column) -> Column:
    """An array of fractional documents in sequence: struct(carry: the last residual, done: the whole ones)."""
    start = F.struct(items.getItem(0).alias("carry"), F.slice(items, 1, 0).alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, lambda acc, x: _let(
        _step(acc["carry"], x), lambda s: F.struct(s["other"].alias("carry"), F.array_append(acc["done"], s["whole"]).alias("done"))))


def _numbered(sizes: DataFrame) -> DataFrame:
    """The rows of ``sizes`` (key, id, size) with ``twin``, which tells rows that agree in all three
    apart. They are counted and written out anew, by many tasks where they are many."""
    same = ["key", "id", "size"]
    counted = stage(sizes.groupBy(*same).agg(F.count(F.lit(1)).alias("twins")), "twins")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("twins") - 1, F.lit(TWINS).cast("long")))
    some = (counted.where("twins > 1").withColumn("begin", begin)
            .repartition(shuffle_partitions(sizes.sparkSession), *same, "begin"))
    last = F.least(F.col("begin") + TWINS, F.col("twins")) - 1
    return (counted.where("twins = 1").select(*same, F.lit(0).cast("long").alias("twin"))
            .unionByName(some.select(*same, F.explode(F.sequence("begin", last)).alias("twin"))))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, ``size``, ``source_size``, ``target``, ``taken``, ``copies``.

    ``size`` is the number of words between white space; ``taken = copies * size``, at most
    ``most`` times the size. The taken words of a source differ from its target by less than
    its largest document. Chance comes from hashes of (id, size, seed), for rows that agree
    in source, id and size also of their number among them: reruns agree.

    A null, empty or blank text has size 0 and 0 copies. Rows without a source are a source
    of their own, last in order. Ids may be null or repeat (rows that agree in id and size
    are exchangeable). If all sizes are 0, all targets are. No rows give no rows. Other
    columns are not read."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sizes = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                              F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0))
                              .cast("long").alias("size"))
                  .withColumn("key", key), "sizes")
    targets = stage(source_targets(sizes, weights, most).drop("source"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of_source = ["rank", "source_size", "target", "base", "n_docs"]
    rows = stage(_numbered(sizes.select("id", "size", "key")), "rows")
    now = (join_by_count(rows, targets.withColumn("n_docs", F.col("n")), "key", "n")
           .withColumn("rate", rate).withColumn("base", F.least(F.floor("rate"), F.lit(most)).cast("long"))
           .withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
           .select("id", "size", "twin", "p", *of_source))
    now = stage(now, "shares")
    fractional = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0)
    settled = [now.where(~fractional)]
    now = now.where(fractional)
    most_docs = targets.agg(F.max("n")).first()[0] or 0
    level, reach = 0, 1
    while reach < most_docs:
        reach *= block
        chance = F.shiftrightunsigned(F.xxhash64("id", "size", "twin", F.lit(seed), F.lit(level)), 11) / F.lit(float(1 << 53))
        blocks = F.ceil(F.col("n_docs") / reach)
        # three independent hashes: the block, the turn inside it, and the chance of each step
        dealt = (now.withColumn("u", chance).withColumn("turn", F.xxhash64("id", "size", "twin", F.lit(seed), F.lit(level), F.lit("turn")))
                 .withColumn("block", F.pmod(F.xxhash64("id", "size", "twin", F.lit(seed), F.lit(level), F.lit("block")), blocks)))
        item = F.struct("turn", "id", "size", "twin", "p", "u")
        grouped = (dealt.groupBy(*of_source, "block").agg(F.array_sort(F.collect_list(item)).alias("items"))
                   .withColumn("items", F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"),
                                                                                x["twin"].alias("twin"), x["p"].alias("p"), x["u"].alias("u"))))
                   .withColumn("r", _rounded(F.col("items")))
                   .select(*of_source, F.explode(F.array_append("r.done", F.col("r.carry"))).alias("x"))
                   .select(F.col("x.id").alias("id"), F.col("x.size").alias("size"), F.col("x.twin").alias("twin"),
                           F.col("x.p").alias("p"), *of_source))
        grouped = stage(grouped, f"level{level}")
        settled.append(grouped.where(~fractional))
        now = grouped.where(fractional)
        level += 1
    last = F.shiftrightunsigned(F.xxhash64("id", "size", "twin", F.lit(seed), F.lit("last")), 11) / F.lit(float(1 << 53))
    settled.append(now.withColumn("p", F.when(last < F.col("p"), 1.0).otherwise(0.0)))
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("p") >= 1).cast("long")).otherwise(F.lit(0).cast("long"))
    return (every.withColumn("copies", copies)
            .select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                    "copies"))
