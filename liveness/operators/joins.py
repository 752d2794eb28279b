"""Joins: feature attachment, history detail, range and name look-ups, cache.

Sides are left to Catalyst's size-checked ``autoBroadcastJoinThreshold`` and AQE; broadcast are
only the rows of hot keys (``skew.split_join``) and the bounded request filter of the cache. The
range look-up is rewritten as an equi-join; names are found in texts by automata over blocks of names."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scores import is_exported
from ..session import materialize
from .skew import split_join


def attach_call_count(entities: DataFrame, counts: DataFrame, name: str = "name",
                      callee: str = "callee", count_col: str = "call_count", heavy: list | None = None) -> DataFrame:
    """entities LEFT JOIN counts ON bare name; missing -> 0. ``counts`` has one row per name.
    A name that many entities have is joined apart (``skew.split_join``)."""
    c = counts.select(F.col(callee).alias("_callee"), F.col(count_col).alias("_n"))
    return (split_join(entities, c, name, "_callee", heavy)
            .withColumn(count_col, F.coalesce(F.col("_n"), F.lit(0)).cast("long"))
            .drop("_callee", "_n"))


def attach_test_usage(entities: DataFrame, test_names: DataFrame, name: str = "name",
                      callee: str = "callee", out: str = "used_in_tests", heavy: list | None = None) -> DataFrame:
    """1 when the entity name is called from any test file, else 0 (existence join on
    the distinct names, so duplicates on the right cannot multiply rows). Hot names as above."""
    t = test_names.select(F.col(callee).alias("_t")).distinct()
    return (split_join(entities, t, name, "_t", heavy)
            .withColumn(out, F.col("_t").isNotNull().cast("int")).drop("_t"))


def attach_usage(entities: DataFrame, usage: DataFrame, name: str = "name", callee: str = "callee",
                 heavy: list | None = None) -> DataFrame:
    """``call_count`` and ``used_in_tests`` of each entity in one left join with
    ``rollups.callee_usage`` on the bare name; names without a reference get 0. Hot names as above."""
    u = usage.select(F.col(callee).alias("_callee"), F.col("call_count").alias("_n"), F.col("in_tests").alias("_t"))
    return (split_join(entities, u, name, "_callee", heavy)
            .withColumn("call_count", F.coalesce("_n", F.lit(0)).cast("long"))
            .withColumn("used_in_tests", F.coalesce("_t", F.lit(0)).cast("int")).drop("_callee", "_n", "_t"))


def attach_features(entities: DataFrame, calls: DataFrame, name: str = "name",
                    path: str = "rel_path", callee: str = "callee",
                    in_test: str = "in_test_file") -> DataFrame:
    """Call count, test usage, export flag and file depth for each entity."""
    from ..functions.scores import file_depth
    from .rollups import callee_usage
    return (attach_usage(entities, callee_usage(calls, callee, in_test), name, callee)
            .withColumn("is_exported", is_exported(name))
            .withColumn("file_depth", file_depth(path)))


def session_entity_join(entities: DataFrame, sessions: DataFrame, project: str | None = None,
                        session_key: str = "id", entity_session: str = "session_id") -> DataFrame:
    s = sessions.select(F.col(session_key).alias(entity_session), "project_path",
                        F.col("timestamp").alias("session_timestamp"))
    if project is not None:
        s = s.where(F.col("project_path") == project)
    return entities.join(s, entity_session)


def entities_for_session(entities: DataFrame, explanations: DataFrame, features: DataFrame,
                         session_id: int | None = None) -> DataFrame:
    """Entities with their explanations and feature vectors (bag semantics: two
    explanations give two rows) plus the parsed explanation JSON (NULL if invalid)."""
    if session_id is not None:
        entities = entities.where(F.col("session_id") == session_id)
    e = explanations.select(
        F.col("entity_id").alias("_e_entity"),
        F.col("summary").alias("explanation_summary"), "risk_level", "confidence_explanation",
        "llm_reasoning", "recommendation", "action", "xai_json")
    fv = features.select(
        F.col("entity_id").alias("_f_entity"), "call_count", "is_exported", "used_in_tests",
        "dynamic_call_risk", "cyclomatic_complexity", "file_depth")
    out = (entities.join(e, entities["id"] == F.col("_e_entity"), "left")
           .join(fv, entities["id"] == F.col("_f_entity"), "left")
           .drop("_e_entity", "_f_entity"))
    if session_id is not None:
        # the order is by a sample of the rows and then the rows: the joined table is staged, not joined twice
        out = materialize(out, "session").orderBy(F.col("confidence_score").desc(), F.col("id").asc())
    return out.withColumn("xai_explanation", F.try_parse_json(F.nullif(F.col("xai_json"), F.lit(""))))  # of sorted rows


def symbol_at_line(symbols: DataFrame, probes: DataFrame, file_col: str = "file_name",
                   line: str = "line", probe_id: str = "probe_id", start: str = "start_line",
                   end: str = "end_line", order: list | None = None, bucket: int = 64,
                   min_conf: float | None = None, conf: str = "confidence") -> DataFrame:
    """For each probe (file, line): the first symbol (by ``order``) with
    start <= line <= end; NULL when none (or, hover form, when its confidence is below
    ``min_conf``).

    Range join as an equi-join: symbols are expanded to the line buckets they cover
    (span / bucket rows each) and joined on (file, bucket), then the range is checked.
    No file-wide pairs are formed."""
    order = order or [start, "entity_id"]
    sym = symbols.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket).cast("long"),
                                        F.floor(F.col(end) / bucket).cast("long"))))
    sym_cols = [c for c in symbols.columns if c != file_col]
    s = sym.select(F.col(file_col).alias("_sf"), "_bucket",
                   *[F.col(c).alias(f"sym_{c}") for c in sym_cols])
    p = probes.withColumn("_pb", F.floor(F.col(line) / bucket).cast("long"))
    cond = ((p[file_col] == s["_sf"]) & (p["_pb"] == s["_bucket"])
            & (F.col(f"sym_{start}") <= p[line]) & (p[line] <= F.col(f"sym_{end}")))
    joined = p.join(s, cond, "left")
    # first symbol per probe as a min_by aggregate (partial aggregation before the
    # shuffle, so a probe hit by many symbols is reduced map-side); unmatched probes
    # have a NULL ordering key and get NULL symbol columns
    probe_cols = [c for c in probes.columns]
    picked = joined.groupBy(*probe_cols).agg(F.min_by(
        F.struct(*[F.col(f"sym_{c}").alias(f"sym_{c}") for c in sym_cols]),
        F.struct(*[F.col(f"sym_{c}") for c in order])).alias("_m"))
    first = picked.select(*probe_cols, *[F.col(f"_m.sym_{c}").alias(f"sym_{c}") for c in sym_cols])
    if min_conf is not None:
        hide = F.col(f"sym_{conf}") < min_conf
        for c in sym_cols:
            first = first.withColumn(f"sym_{c}", F.when(hide, F.lit(None)).otherwise(F.col(f"sym_{c}")))
    return first


#: Names of one automaton, and questions that one of them reads; a file with more is dealt over several.
NAMES_PER_BLOCK, QUESTIONS_PER_CHUNK = 100_000, 20_000


def _name_matcher(order: list[str], out: list[str]):
    """From rows sorted by (file, name block, question chunk, names first): for each question the first
    of the block's names, by ``order``, that occurs in its text. The names of a group become one
    automaton (a trie with failure links), and a question is read once, whatever the number of names."""
    def first_by(name_rows: pa.Table) -> tuple[pa.Table, ahocorasick.Automaton]:
        ranked = sorted(range(name_rows.num_rows), key=lambda i: [(k[i] is not None, k[i]) for k in keys]
                        ) if (keys := [name_rows.column(c).to_pylist() for c in order]) else range(name_rows.num_rows)
        found = name_rows.take(pa.array(ranked, pa.int64()))
        automaton = ahocorasick.Automaton()
        for i, name in enumerate(found.column("_text").to_pylist()):
            automaton.add_word(name, i)
        automaton.make_automaton()
        return found, automaton

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, index = None, [], None
        for batch in batches:
            place = list(zip(*(batch.column(c).to_pylist() for c in ("_file", "_nb", "_qc", "_kind"))))
            at = 0
            while at < len(place):
                to = at
                while to < len(place) and place[to] == place[at]:
                    to += 1
                piece, (*here, kind) = batch.slice(at, to - at), place[at]
                at = to
                if here != group:
                    group, names, index = here, [], None
                if kind == 0:
                    names.append(piece)
                elif names:
                    index = index or first_by(pa.Table.from_batches(names))
                    found, automaton = index
                    best = [min((i for _, i in automaton.iter(text)), default=None) for text in piece.column("_text").to_pylist()]
                    hit = [i is not None for i in best]
                    if any(hit):
                        rows = found.take(pa.array([i for i in best if i is not None], pa.int64())).select(out)
                        asked = piece.filter(pa.array(hit)).column("_qid")
                        yield from rows.add_column(0, "_qid", asked).to_batches()

    return match


def symbol_named_in_text(questions: DataFrame, symbols: DataFrame, file_col: str = "file_name",
                         qid: str = "question_id", text: str = "text", name: str = "name",
                         order: list | None = None, names_per_block: int = NAMES_PER_BLOCK,
                         questions_per_chunk: int = QUESTIONS_PER_CHUNK) -> DataFrame:
    """For each question: the first symbol of its file whose lower-cased name occurs in the
    lower-cased question. "First" is by ``order``: start line, then id, if the symbols have a
    start line, else id.

    Symbols are first reduced to one per (file, lower-cased name). A file's names are dealt into blocks,
    its questions into chunks, and each pair of them is a group whose names become one automaton: the work is
    linear in the texts, and a group gives at most one row per question. Files with a
    large share of all names or questions are spread over their groups; empty names and null texts match nothing."""
    from .ordering import first_seen
    order = order or [c for c in ("start_line", "entity_id") if c in symbols.columns]
    cols = [c for c in symbols.columns if c != file_col]
    sym = first_seen(symbols.where(F.length(F.col(name)) > 0).withColumn("_lname", F.lower(F.col(name))),
                     [file_col, "_lname"], order)
    sym = materialize(sym.select(F.col(file_col).alias("_file"), F.col("_lname").alias("_text"), *[F.col(c).alias(f"sym_{c}") for c in cols]),
                      "names")
    asked = questions.where(F.col(text).isNotNull()).select(F.col(file_col).alias("_file"), F.lower(F.col(text)).alias("_text"),
                                                            F.col(qid).alias("_qid"))
    sizes = (sym.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
             .join(asked.groupBy("_file").agg(F.count(F.lit(1)).alias("m")), "_file")
             .select(F.col("_file").alias("_of"), F.ceil(F.col("n") / names_per_block).cast("int").alias("_nbs"),
                     F.ceil(F.col("m") / questions_per_chunk).cast("int").alias("_qcs")))
    sizes = materialize(sizes, "sizes")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda value, n: F.pmod(F.xxhash64(value), F.col(n)).cast("int")
    names = split_join(sym, sizes, "_file", "_of").where("_of is not null").withColumns({"_nb": of("_text", "_nbs"), "_qc": upto("_qcs")})
    texts = split_join(asked, sizes, "_file", "_of").where("_of is not null").withColumns({"_qc": of("_qid", "_qcs"), "_nb": upto("_nbs")})
    group = ["_file", "_nb", "_qc"]
    rows = (names.select(*group, F.lit(0).alias("_kind"), "_text", F.lit(None).cast(questions.schema[qid].dataType).alias("_qid"),
                         *[f"sym_{c}" for c in cols])
            .unionByName(texts.select(*group, F.lit(1).alias("_kind"), "_text", "_qid"), allowMissingColumns=True))
    parts = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = sym.select(*[f"sym_{c}" for c in cols])
    schema = StructType([StructField("_qid", questions.schema[qid].dataType), *[StructField(f.name, f.dataType) for f in out.schema]])
    hits = (rows.repartition(parts, *group).sortWithinPartitions(*group, "_kind")
            .mapInArrow(_name_matcher([f"sym_{c}" for c in order], out.columns), schema))
    first = hits.groupBy("_qid").agg(F.min_by(F.struct(*out.columns), F.struct(*[f"sym_{c}" for c in order])).alias("_m"))
    return questions.join(first.select(F.col("_qid").alias(qid), "_m.*"), qid, "left")


def explanation_cache_hit(requests: DataFrame, cache: DataFrame, key: str = "content_key") -> DataFrame:
    """Requests with their cached explanation (NULL when not cached)."""
    c = cache.select(F.col(key).alias("_ck"), *[F.col(x).alias(f"cached_{x}")
                                                for x in cache.columns if x != key])
    return requests.join(c, requests[key] == c["_ck"], "left").drop("_ck")


#: Bits of the request filter for each request, set in one of its blocks, and the most blocks (of 32,768 bits).
BLOOM_BITS, BLOOM_PROBES, BLOOM_BLOCKS = 16, 4, 1 << 14
_BLOCK_BITS = 1 << 15


def _bloom(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """(block, bits): a Bloom filter of ``n`` keys, each in one block; and the number of blocks."""
    blocks = max(1, min(BLOOM_BLOCKS, -(-n * BLOOM_BITS // _BLOCK_BITS)))
    h = F.xxhash64(key)
    probes = F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(_BLOCK_BITS)) for i in range(BLOOM_PROBES)])
    return (keys.select(F.pmod(h, F.lit(blocks)).cast("int").alias("_block"), F.explode(probes).alias("_bit"))
            .groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))), blocks


def _maybe_in(key: str) -> Column:
    """Are the bits of ``key`` all set in ``_bits``? A bitmap's bit b is bit b % 8 of byte b / 8."""
    out = F.lit(True)
    for i in range(BLOOM_PROBES):
        bit = F.pmod(F.xxhash64(key, F.lit(i)), F.lit(_BLOCK_BITS)).cast("int")
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.call_function("shiftright", byte, bit % 8).bitwiseAND(F.lit(1)) == 1)
    return out


def requested(cache: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """The rows of ``cache`` whose key may be among the requests': all that are, and about one in 400 of the others
    (more beyond 33 million keys). A Bloom filter of the requests is broadcast (64 MB at most) and
    applied where the cache is read, so the rest of it never moves."""
    keys = materialize(requests.select(key).where(F.col(key).isNotNull()).distinct(), "requested")
    bits, blocks = _bloom(keys, key, keys.count())
    filtered = cache.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).join(
        F.broadcast(materialize(bits, "bloom")), "_block")  # BLOOM_BLOCKS rows at most
    return filtered.where(_maybe_in(key)).select(*cache.columns)


def explanation_cache_miss(requests: DataFrame, cache: DataFrame, key: str = "content_key",
                           order: list[str] | None = None) -> DataFrame:
    """Requests not in the cache, one per key: the first by ``order`` and then by all other columns, so the
    result does not depend on how the rows are partitioned. A null key is in no cache: one request of it stays.
    Of the cache, only rows that pass the request filter (``requested``) are shuffled."""
    from .ordering import first_seen
    missing = requests.join(requested(cache.select(key), requests, key), key, "left_anti")
    rest = [c for c in requests.columns if c != key and c not in (order or [])]
    return first_seen(missing, [key], [*(order or []), *rest]).select(*requests.columns)
