"""Line-level operators on source text: regex symbol extraction and line-range removal.

Both work per row on arrays (split -> filter/transform -> join): a file is never
exploded into per-line rows that would have to be grouped back together. Line ranges are
merged by windows before they meet the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# FIXED VALUES: line-anchored symbol patterns per language (list order matters: the
# first pattern that yields a name claims it), and the kind each pattern reports.
SYMBOL_PATTERNS = {
    "python": [
        (r"^(?:async\s+)?def\s+(\w+)\s*\(", "function"),
        (r"^class\s+(\w+)\s*[:(]", "class"),
    ],
    "javascript": [
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", "function"),
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(", "variable"),
        (r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\w+\s*=>", "variable"),
    ],
    "typescript": [
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*[<(]", "function"),
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?const\s+(\w+)\s*(?::\s*\w+\s*)?=\s*(?:async\s*)?\(", "variable"),
        (r"^(?:private|protected|public|static)?\s+(?:async\s+)?(\w+)\s*\(", "function"),
    ],
}
MIN_NAME_LENGTH = 2


def pattern_language(language) -> Column:
    """python / typescript / javascript; react variants map to their base language and
    anything else uses the javascript patterns."""
    lang = F.replace(F.coalesce(F.col(language) if isinstance(language, str) else language, F.lit("")),
                     F.lit("react"), F.lit(""))
    return F.when(lang.isin("python", "typescript"), lang).otherwise(F.lit("javascript"))


def _slot_extract(line: Column, lang: Column, k: int) -> tuple[Column, Column]:
    """(name, kind) found by pattern slot ``k`` of the line's language; literal patterns
    only, so each compiles once per task."""
    name = None
    kind = None
    for lg, pats in SYMBOL_PATTERNS.items():
        if k < len(pats):
            pat, knd = pats[k]
            hit = F.regexp_extract(line, pat, 1)
            name = F.when(lang == lg, hit) if name is None else name.when(lang == lg, hit)
            kind = F.when(lang == lg, F.lit(knd)) if kind is None else kind.when(lang == lg, F.lit(knd))
    return name, kind


def regex_symbols(files: DataFrame, path: str = "rel_path", content: str = "content",
                  language: str = "language", dedupe: bool = True) -> DataFrame:
    """Symbols found by the per-language line patterns: (path, name, kind,
    pattern_no, start_line, snippet). With ``dedupe`` a name is kept once per file, by
    (pattern order, position). Patterns are applied line by line, so a ``\\s`` that
    would cross a line break in a whole-text match does not.

    One pass per file: a line is first tested against its language's patterns at once; only
    those that match yield one struct per pattern slot (a CASE on the language picks the literal
    pattern), and only the symbols that are left after that get their snippet."""
    n = max(len(v) for v in SYMBOL_PATTERNS.values())
    base = files.select(path, F.split(F.col(content), "\n", -1).alias("_lines"),
                        pattern_language(language).alias("_lang"))

    def worth(x: Column) -> Column:
        test = None
        for lg, pats in SYMBOL_PATTERNS.items():
            hit = x["line"].rlike("|".join(p for p, _ in pats))
            test = F.when(F.col("_lang") == lg, hit) if test is None else test.when(F.col("_lang") == lg, hit)
        return test

    def slots(x: Column) -> Column:
        found = []
        for k in range(n):
            name, kind = _slot_extract(x["line"], F.col("_lang"), k)
            found.append(F.struct(F.lit(k).alias("pattern_no"), F.coalesce(name, F.lit("")).alias("name"),
                                  kind.alias("kind"), x["no"].alias("start_line"), x["line"].alias("line")))
        return F.array(*found)

    numbered = F.transform("_lines", lambda ln, i: F.struct(ln.alias("line"), (i + 1).alias("no")))
    base = base.withColumn("_hits", F.filter(numbered, worth))
    found = F.filter(F.flatten(F.transform("_hits", slots)), lambda s: F.length(s["name"]) >= MIN_NAME_LENGTH)
    out = base.select(path, F.explode(found).alias("_m")).select(
        path, "_m.name", "_m.kind", "_m.pattern_no", "_m.start_line",
        F.regexp_replace("_m.line", r"(?U)^\s+|\s+$", "").alias("snippet"))
    if dedupe:
        out = first_seen_symbols(out, path)
    return out


def first_seen_symbols(symbols: DataFrame, path: str = "rel_path") -> DataFrame:
    """One row per (file, name): the first by (pattern order, position)."""
    from .ordering import first_seen
    return first_seen(symbols, [path, "name"], ["pattern_no", "start_line"])


#: Start lines of one block, in which ranges are first merged.
MERGE_BLOCK = 1 << 14


def _islands(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or adjacent (s, e) of each group folded into one: a range begins an island if it starts
    behind all ends before it (a running maximum)."""
    before = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce(F.col("s") > F.max("e").over(before) + 1, F.lit(True)).cast("int")
    return (ranges.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(upto))
            .groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island"))


def merged_ranges(ranges: DataFrame, path: str = "path", start: str = "start_line", end: str = "end_line",
                  extra_lines: int = 0, block: int = MERGE_BLOCK) -> DataFrame:
    """(path, s, e): the disjoint stretches that the 1-based inclusive ranges of each file cover, ``extra_lines`` after
    each range included. A null start is line 1, a null end the last line; empty ranges cover nothing.

    Ranges that start at one line become one where they lie (a partial aggregate), so a file has at
    most as many rows as start lines; these are merged in blocks of start lines, and what is left in one more
    pass over the file's islands."""
    end_at = F.least(F.col(end).cast("long") + extra_lines, F.lit(1 << 40))
    r = ranges.select(F.col(path).alias("_path"), F.greatest(F.col(start).cast("long"), F.lit(1)).alias("s"),
                      F.coalesce(end_at, F.lit(1 << 40)).alias("e")).where("s <= e")
    r = r.groupBy("_path", "s").agg(F.max("e").alias("e")).withColumn("_block", F.floor(F.col("s") / block))
    return _islands(_islands(r, ["_path", "_block"]).drop("_block"), ["_path"]).withColumnRenamed("_path", path)


def remove_line_ranges(files: DataFrame, ranges: DataFrame, path: str = "path",
                       content: str = "content", start: str = "start_line", end: str = "end_line",
                       extra_lines: int = 0) -> DataFrame:
    """Delete 1-based inclusive line ranges (overlaps merge) from each file's text.

    Returns (path, new_content, removed_lines). ``extra_lines=1`` reproduces the editor
    behaviour: the line after the range goes too, and when the deletion reaches the end
    of the text the newline before it stays (the text keeps a final line break).
    Ranges are merged before they meet the text (``merged_ranges``); the disjoint ones, half as many as
    the file has lines at most, are collected beside it and the text between them is sliced
    out, so the work is linear in lines plus ranges."""
    cuts = (merged_ranges(ranges, path, start, end, extra_lines).withColumnRenamed(path, "_path").groupBy("_path")
            .agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_ranges")))
    j = files.join(cuts, F.col(path) == F.col("_path"), "left")
    j = j.withColumn("_lines", F.split(F.col(content), "\n", -1)).withColumn("_n", F.size("_lines"))
    given = F.coalesce(F.col("_ranges"), F.array().cast("array<struct<s:bigint,e:bigint>>"))
    j = j.withColumn("_cut", F.transform(F.filter(given, lambda r: r["s"] <= F.col("_n")), lambda r: F.struct(
        r["s"].cast("int").alias("s"), F.least(r["e"], F.col("_n").cast("long")).cast("int").alias("e"))))
    # kept stretches: before the first cut, between cuts, after the last
    froms = F.concat(F.array(F.lit(1)), F.transform("_cut", lambda r: r["e"] + 1))
    tos = F.concat(F.transform("_cut", lambda r: r["s"] - 1), F.array(F.col("_n")))
    j = j.withColumn("_stretches", F.filter(F.arrays_zip(froms.alias("a"), tos.alias("b")), lambda x: x["a"] <= x["b"]))
    j = j.withColumn("_kept", F.flatten(F.transform("_stretches", lambda x: F.slice(F.col("_lines"), x["a"], x["b"] - x["a"] + 1))))
    out = F.col("_kept")
    if extra_lines > 0:
        last_removed = F.coalesce(F.try_element_at(F.col("_cut"), F.lit(-1))["e"] >= F.col("_n"), F.lit(False))
        out = F.when((F.size("_cut") > 0) & last_removed & (F.size("_kept") > 0), F.concat("_kept", F.array(F.lit("")))).otherwise(out)
    return j.select(path, F.array_join(out, "\n").alias("new_content"),
                    (F.col("_n") - F.size("_kept")).alias("removed_lines"))


def removal_rows(files: DataFrame, ranges: DataFrame, path: str = "path", content: str = "content",
                 start: str = "start_line", end: str = "end_line", conf: str = "confidence",
                 entity_id: str | None = None, extra_lines: int = 0) -> DataFrame:
    """Log rows for removals: the removed text of each range (lines start..end, plus
    ``extra_lines`` in editor mode, clipped to the file), its confidence and entity id
    (0 when ad hoc)."""
    lines = F.split(F.col(content), "\n", -1)
    j = ranges.join(files.select(path, lines.alias("_lines")), path)
    lo = F.greatest(F.col(start), F.lit(1))
    hi = F.least(F.col(end) + extra_lines, F.size("_lines"))
    removed = F.when(hi >= lo, F.array_join(F.slice("_lines", lo, hi - lo + 1), "\n")).otherwise(F.lit(""))
    eid = F.col(entity_id).cast("long") if entity_id else F.lit(0).cast("long")
    return j.select(eid.alias("entity_id"), F.col(path).alias("file_name"), removed.alias("removed_code"),
                    F.col(conf).cast("double").alias("confidence_score"))
