"""Secret scan with corpus-wide ownership: how many repositories and owners hold a value?

Patterns give base spans. Their values, and other token-like strings, are candidates; each
candidate's hash is counted by distinct repository and owner over the whole corpus. Values
that several owners hold are copied examples; values of one owner that look random are taken
for live credentials. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_count, span_text, stage

#: The base patterns, and for each the least length of its group.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"     # a run too short from its first AKIA is too short from any other
HEX = "[0-9a-f]{16,}"            # runs are maximal, so shorter ones are dropped whole
ASSIGN_LEAST = 12
#: Token-like strings outside the base patterns: candidates only.
BARE = "(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_.=-])"
_SPANS = "array<struct<kind:string,start:int,end:int,from:int,value:string>>"
#: Matches of a text whose offsets are added up in one array; more are added up block by block.
BLOCK = 256
KINDS = ("assign", "access", "hex", "copied", "live")
#: Words that mark a placeholder rather than a credential.
PLACEHOLDER = "(?i)example|sample|changeme|placeholder|your|dummy|xxxx|0123456|123456|abcdef"


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of struct(kind, start, end, from, value) of the pattern's leftmost matches, where
    ``value`` is the group, which ends the match, and starts at ``from``. The texts between
    matches give the offsets, in code points."""
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sizes = F.zip_with(F.zip_with(pieces, whole, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m"))), values,
                       lambda x, v: F.struct(x["p"].alias("p"), x["m"].alias("m"), v.alias("v")))
    sizes = F.filter(sizes, lambda x: x["m"].isNotNull())  # the piece after the last match

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        end = start + x["m"]
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"),
                       (end - F.length(x["v"])).alias("from"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    # an array that grows in an accumulator is copied for each match, so it never grows past a block
    def offsets(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["p"] + x["m"]))
        return _let(totals, lambda t: _let(_blocks(t), lambda groups: F.flatten(F.zip_with(
            groups, _upto(F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda acc, x: acc + x)), F.lit(0)), _upto))))

    def located(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, offsets(blocks), lambda b, first: F.aggregate(
            b, F.struct(first.alias("at"), F.array().cast(_SPANS).alias("out")), add, lambda acc: acc["out"])))

    found = _let(sizes, lambda x: _let(_blocks(x), located))
    return F.filter(found, lambda s: F.length(s["value"]) >= least) if least else found


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _upto(sizes: Column, first: Column) -> Column:
    """Where each of some pieces begins, if the first begins at ``first``."""
    return F.aggregate(sizes, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")),
                       lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
                       lambda acc: acc["out"])


def _blocks(values: Column) -> Column:
    """The array (one that is named, not computed) in pieces of ``BLOCK``."""
    last = F.ceil(F.size(values) / BLOCK).cast("int") - 1
    none = F.slice(F.array(values), 1, 0)
    return F.when(last < 0, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                                        lambda k: F.slice(values, k * BLOCK + 1, BLOCK)))


def _base(text: Column) -> tuple[Column, Column, Column, Column]:
    """Spans of each kind and of bare candidates. A cheap test lets most texts pass without matching."""
    none = F.array().cast(_SPANS)
    when = lambda test, spans: F.when(test, spans).otherwise(none)
    return (when(text.contains("=") | text.contains(":"), _spans(text, ASSIGN, "assign", 2, ASSIGN_LEAST)),
            when(text.contains("AKIA"), _spans(text, ACCESS, "access")),
            when(text.rlike(HEX), _spans(text, HEX, "hex")),
            when(text.rlike(BARE), F.filter(_spans(text, BARE, "bare"),
                                            lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))))


def _ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def _looks_random(value: Column) -> Column:
    """At least 12 characters, 8 different ones, digits and letters, no placeholder word."""
    return ((F.length(value) >= 12) & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
            & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER))


def ownership(candidates: DataFrame, wide: int = 3, narrow: int = 2) -> DataFrame:
    """``candidates`` (hash, repository, owner) per hash: n_repositories, n_owners, n rows, and
    ``verdict``: "copied" (``wide`` owners or more), "owned" (one, in ``narrow`` of its repositories at most), null
    for what lies between: a value that an owner has spread over many repositories is no stray key.

    Counted in three steps that aggregate before each shuffle, so one value in a third of
    all rows arrives as one row per repository and task."""
    by_repository = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return (by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"),
                                         F.sum("n").alias("n"))
            .withColumn("verdict", F.when(F.col("n_owners") >= wide, "copied")
                        .when((F.col("n_owners") == 1) & (F.col("n_repositories") <= narrow), "owned")))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | str = "source",
                repository: Column | str = "source", wide: int = 3, narrow: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>``, n_assign, n_access, n_hex, ``base`` and ``spans``
    (text: kind:start:end, comma-joined), n_copied, n_live, ``held`` (kind:start:end:owners:repositories of
    the added spans, in the same order).

    Base spans are those of the three patterns. The scan adds, for each candidate value, a
    span "copied" when ``wide`` owners or more hold the value anywhere in the corpus, and
    "live" when exactly one does, in ``narrow`` of its repositories at most, and it looks random.
    Offsets are code points, end exclusive.

    A null text is empty and has no spans. A null owner or repository is one of its own. Ids
    may be null or repeat; repeated rows give equal rows (and count once per repository). No
    rows give no rows. Other columns are not read. Texts are read once; only spans and
    hashes of candidates are shuffled."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(col(owner).cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(col(repository).cast("string"), F.lit("")).alias("repository"))
    assign, access, hexes, bare = _base(F.col("text"))
    rows = stage(rows.select("id", "owner", "repository", assign.alias("a"), access.alias("k"), hexes.alias("h"), bare.alias("b"))
                 .withColumn("row_id", F.monotonically_increasing_id()), "secrets")
    every = F.concat("a", "k", "h", "b")
    found = (rows.where(F.size(every) > 0).select("row_id", "owner", "repository", F.explode(every).alias("s"))
             .select("row_id", "owner", "repository", F.col("s.from").alias("start"), F.col("s.end").alias("end"),
                     F.sha2("s.value", 256).alias("hash"), _looks_random(F.col("s.value")).alias("random")).distinct())
    found = stage(found, "candidates")
    held = stage(ownership(found.select("hash", "owner", "repository"), wide, narrow)
                 .select("hash", "verdict", "n_owners", "n_repositories", "n"), "ownership")
    kind = F.when(F.col("verdict") == "copied", "copied").when((F.col("verdict") == "owned") & F.col("random"), "live")
    judged = (join_by_count(found, held, "hash", "n").withColumn("kind", kind).where("kind is not null")
              .groupBy("row_id").agg(F.collect_list(F.struct("kind", "start", "end", "n_owners", "n_repositories")).alias("judged")))
    plain = F.transform(F.concat("a", "k", "h"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    judgements = F.coalesce("judged", F.array().cast("array<struct<kind:string,start:int,end:int,n_owners:bigint,n_repositories:bigint>>"))
    more = F.transform(judgements, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    held = F.array_join(F.transform(F.array_sort(F.transform(judgements, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["n_owners"].alias("o"), s["n_repositories"].alias("r")))),
        lambda s: F.concat_ws(":", s["kind"], *[s[c].cast("string") for c in ("start", "end", "o", "r")])), ",")
    count = lambda k: F.size(F.filter(more, lambda s: s["kind"] == k)).cast("long")
    return (rows.join(judged, "row_id", "left")
            .select(F.col("id").alias(id_col), F.size("a").cast("long").alias("n_assign"), F.size("k").cast("long").alias("n_access"),
                    F.size("h").cast("long").alias("n_hex"), span_text(_ordered(plain)).alias("base"),
                    span_text(_ordered(F.concat(plain, more))).alias("spans"), count("copied").alias("n_copied"), count("live").alias("n_live"),
                    held.alias("held")))
