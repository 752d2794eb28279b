"""Result-row shaping: raw analyzer rows -> the result shape consumers read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_results(raw: DataFrame, name: str = "name", kind: str = "kind",
                      start: str = "start_line") -> DataFrame:
    """id = name_startLine; kind is 'class' or 'function'; missing lists -> [];
    missing text -> ''; snippet cut to its first line."""
    cols = set(raw.columns)
    out = [
        F.concat_ws("_", F.col(name), F.col(start).cast("string")).alias("id"),
        F.col(name).alias("name"),
        F.when(F.col(kind) == "class", "class").otherwise("function").alias("kind"),
        F.col(start).alias("start_line"), "end_line", "confidence",
    ]
    for c in ("reasons_dead", "reasons_alive"):
        if c in cols:
            out.append(F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c))
    for c in ("summary", "explanation"):
        if c in cols:
            out.append(F.coalesce(F.col(c), F.lit("")).alias(c))
    if "snippet" in cols:
        out.append(F.coalesce(F.split(F.col("snippet"), "\n").getItem(0), F.lit("")).alias("snippet"))
    return raw.select(*out)
