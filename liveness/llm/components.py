"""Connected components of a link table, as alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, join_by_count, stage


def _star(links: DataFrame, large: bool, rows: int) -> DataFrame:
    """One step over links (a, b), a > b. Large star: every node hands its larger neighbours
    the smallest node it sees; small star: its smaller ones, and itself."""
    both = links
    if large:
        both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links", 2 * rows)
    low = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")), "lows", 2 * rows)
    met = join_by_count(both, low, "a", "n")
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = (met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(low.select("a", F.col("m").alias("b"))))
    out = stage(out.where(F.col("a") != F.col("b")).distinct(), "star", 2 * rows)
    drop_stage(low, *([both] if large else []))
    return out


def _stars(links: DataFrame) -> bool:
    """Are these stars already: every node linked to one smaller node, which is linked to none?"""
    n, nodes = links.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    return n == nodes and links.join(links.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b: long; a staged table): the smallest node of
    its component. Loops and repeated links do no harm; no links give no rows.

    Each step is a few aggregations and joins over the links; hot nodes are joined apart.
    The number of steps grows with the logarithm of the longest path. Every step is written,
    so a lost executor never costs more than one of them."""
    now = stage(links.where(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", links.count())
    while not _stars(now):
        rows = now.count()
        large = _star(now, True, rows)
        small = _star(large, False, rows)
        drop_stage(now, large)
        now = small
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
