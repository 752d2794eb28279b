"""Legacy user import and hygiene: parse legacy lines, rename columns, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import short_hash_id


def parse_legacy_csv(lines: DataFrame, value: str = "value", order: str | None = None) -> DataFrame:
    """Raw lines -> (name, email) for lines with at least two comma-separated parts
    (after stripping the line); extra parts are ignored."""
    parts = F.split(F.regexp_replace(F.col(value), r"(?U)^\s+|\s+$", ""), ",", -1)
    keep = [order] if order else []
    return (lines.select(*keep, parts.alias("_p")).where(F.size("_p") >= 2)
            .select(*keep, F.col("_p")[0].alias("name"), F.col("_p")[1].alias("email")))


def migrate_columns(df: DataFrame) -> DataFrame:
    """username -> name and pass -> password_hash, for the columns that are present."""
    mapping = {k: v for k, v in {"username": "name", "pass": "password_hash"}.items() if k in df.columns}
    return df.withColumnsRenamed(mapping) if mapping else df


def import_users(existing: DataFrame, legacy: DataFrame, order: str) -> tuple[DataFrame, Observation]:
    """Upsert legacy (name, email) rows into ``existing`` keyed by the short hash of the
    e-mail; later rows win (legacy over existing, then by ``order``). Returns
    (users, observation): once the users have been written, ``imported(observation)`` is the number of
    legacy rows before de-dup, counted in the same pass."""
    seen = Observation("legacy")
    new = legacy.observe(seen, F.count(F.lit(1)).alias("rows")).select(
        short_hash_id("email").alias("user_id"), "name", "email",
        F.lit(True).alias("active"), F.lit(1).alias("_src"), F.col(order).alias("_ord"))
    old = existing.select("user_id", "name", "email", "active", F.lit(0).alias("_src"),
                          F.lit(None).cast(new.schema["_ord"].dataType).alias("_ord"))
    from .ordering import latest_per_key
    # max over (source, order): legacy rows beat existing ones, later lines beat earlier
    users = latest_per_key(old.unionByName(new), ["user_id"], ["_src", "_ord"]).drop("_src", "_ord")
    return users, seen


def imported(seen: Observation) -> int:
    """The number of legacy rows; waits for the first action on the users."""
    return seen.get.get("rows", 0)
