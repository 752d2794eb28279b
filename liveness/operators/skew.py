"""Joins that no hot key can put into one task.

Hot keys are found by a bounded sketch of the left side; their rows meet the few rows of the
right side where they lie, the rest is joined by shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: The sketch's counters; a key's count is off by at most 3.5 / SKETCH of all rows.
SKETCH = 1 << 13


def heavy_keys(rows: DataFrame, key: str, share: float | None = None) -> list:
    """The keys that hold more than ``share`` of all rows (about; none above twice that is missed), None for
    nulls. The default is half a shuffle partition's part. Frequent-items sketches of the tasks
    are merged: a bounded number of counters whatever the number of keys, and at most 2 / share keys come back."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(share or 1 / (2 * parts), 4 / SKETCH)
    top = rows.agg(F.expr(f"approx_top_k(`{key}`, {min(int(2 / share), SKETCH // 2)}, {SKETCH})").alias("top"),
                   F.count(F.lit(1)).alias("n")).first()
    return [t["item"] for t in top["top"] or [] if t["count"] > share * top["n"]]


def split_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, heavy: list | None = None) -> DataFrame:
    """``left LEFT JOIN right ON left_key = right_key`` for a right side with at most one row per key.

    Rows of ``left`` under a heavy key, or none, do not move: the right side's rows of the heavy
    keys, at most one each, are broadcast. ``heavy``: the keys, if known (a stream cannot be
    sketched first). ``left`` is read three times where there are heavy keys: hand in a table, not a
    costly computation; ``right`` is staged then, and computed once."""
    if heavy is None:
        heavy = heavy_keys(left, left_key)
    if not heavy:
        return left.join(right, F.col(left_key) == F.col(right_key), "left")
    right = materialize(right, "right")
    among = lambda c: F.col(c).isin([k for k in heavy if k is not None] or [None])  # noqa: E731  null for a null key, or if there is none
    apart = F.col(left_key).isNull() | F.coalesce(among(left_key), F.lit(False))
    same = F.col(left_key) == F.col(right_key)
    hot = left.where(apart).join(F.broadcast(right.where(among(right_key))), same, "left")
    cold = left.where(~apart).join(right.where(~F.coalesce(among(right_key), F.lit(False))), same, "left")
    return hot.unionByName(cold)
