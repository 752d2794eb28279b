"""Source divergence audit: how the word use of each source differs from that of every other
source of its language, and which words set it apart from the language.

Texts are tokenized by one table: ``bytes.translate`` lowers letters and blanks separators,
``bytes.split`` and a ``Counter`` per document give its terms. Counts are added up by
(language, source, term), and only terms that occur are ever stored."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stage

#: A-Z are lowered, a-z and all bytes above ASCII stay, everything else separates terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Different (language, source, term) a task counts before it sends them on.
HELD = 1 << 18
#: Bytes of a text that are split at once.
_PIECE = 1 << 22
#: Added to every count, and the scale of shares.
PRIOR, SCALE = 5, 1_000_000_000
#: Sources and terms of one group of the pair sums: its matrix has at most about 2 * 128 x 4,096 numbers.
SOURCES, TERMS = 128, 4096


# ------------------------------------------------------------------ counting

def terms(text: bytes) -> Counter:
    """Counts of the terms of one text, split in pieces that end at a separator."""
    text = text.translate(TABLE)
    if len(text) <= _PIECE:
        return Counter(text.split())
    found: Counter = Counter()
    at = 0
    while at < len(text):
        to = text.find(b" ", at + _PIECE)
        to = len(text) if to < 0 else to
        found.update(text[at:to].split())
        at = to
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the rows of a task, each a few times at most."""
    occurs: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurs.items():
            of = docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array([source] * len(counts), pa.string()),
                 pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64()),
                 pa.array([of[t] for t in counts], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        occurs.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own = terms(text.as_buffer().to_pybytes())
            if own:
                total = occurs.setdefault((lang, source), Counter())
                before = len(total)
                for t, n in own.items():
                    total[t] += n
                docs.setdefault((lang, source), Counter()).update(own.keys())
                held += len(total) - before
                if held > HELD:
                    yield from out()
                    held = 0
    yield from out()


# ------------------------------------------------------------------ sums over pairs

def _pair_sums(rows: pa.Table) -> pa.Table:
    """Sums of one group of sources and terms for each pair of sources: by how much the terms
    that occur here move the sum from what it were if none occurred (which group 0 adds, once for all terms).

    Rows without a term carry the share of an absent one and the number of terms of the language."""
    lang, tb, i, j = (rows.column(c)[0].as_py() for c in ("lang", "tb", "i", "j"))
    mark = rows.filter(pc.is_null(rows.column("term")))
    name, base, block = mark.column("source").to_pylist(), mark.column("p").to_numpy(), mark.column("block").to_numpy()
    row_of = {s: k for k, s in enumerate(name)}
    here = rows.filter(pc.is_valid(rows.column("term")))
    code = here.column("term").combine_chunks().dictionary_encode()
    n_terms = len(code.dictionary)
    share = np.repeat(base[:, None], n_terms, axis=1)
    if n_terms:
        share[[row_of[s] for s in here.column("source").to_pylist()], code.indices.to_numpy()] = here.column("p").to_numpy()
    every = mark.column("kept")[0].as_py() if tb == 0 else 0
    left, right, total = [], [], []
    for x in np.flatnonzero(block == i):
        others = np.flatnonzero(block == j) if i != j else np.arange(x + 1, len(name))
        if len(others):
            gone = np.abs(base[others] - base[x])
            total.append(np.abs(share[others] - share[x]).sum(axis=1) + (every - n_terms) * gone)
            left += [name[x]] * len(others)
            right += [name[y] for y in others]
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()),
                     "value": pa.array(np.concatenate(total) if total else [], pa.int64())})


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exact for counts of any size; null without kept terms."""
    over = F.lit(SCALE).cast("decimal(12,0)") * (count + PRIOR).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", over, total + PRIOR * kept)


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      least_docs: int = 30, top: int = 50, sources: int = SOURCES, block_terms: int = TERMS) -> DataFrame:
    """Rows of two parts for each (language, source) of ``docs``: ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    A language keeps the terms of at least ``least_docs`` of its documents. The share of a kept
    term in a source, or in the whole language, is 1 + floor(10^9 * (count + 5) / (all counts + 5 * kept terms)).
    ``pair``: for every other source of the language the sum of the shares' absolute
    differences over all kept terms (0 if none). ``term``: the ``top`` kept terms that occur in the source and have a larger share
    there than in the language, with the difference. Ranks go by value, falling, then by item.

    Null texts, languages and sources are empty strings. Sources without terms take part with counts of 0.
    Repeated rows count as often as they occur. An empty table gives no rows. Other columns are not read.

    The sum over a pair is built from groups of ``sources`` sources and ``block_terms`` terms, as a
    sum of small dense matrices; no term is joined with itself over all its sources."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    counts = stage(source.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
                   .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = stage(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"))
                 .where(F.col("docs") >= least_docs).drop("docs"), "kept")
    groups = stage(source.select("lang", "source").distinct(), "groups")
    held = stage(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "held")

    langs = (groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
             .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("total_lang")), "lang", "left")
             .na.fill(0, ["kept", "total_lang"])
             .withColumns({"s_blocks": F.ceil(F.col("n_sources") / sources).cast("int"),
                           "t_blocks": F.greatest(F.lit(1), F.ceil(F.col("kept") / block_terms)).cast("int")}))
    langs = stage(langs, "langs")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stage(groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(bounded(langs), "lang")
                   .withColumn("block", F.pmod(F.xxhash64("source"), F.col("s_blocks")).cast("int")), "groups")

    shares = held.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))
    shares = stage(shares.select("lang", "source", "term", "n_lang", "total_lang", "kept", "s_blocks", "t_blocks", "block", "p"), "shares")

    place = ["lang", "tb", "i", "j", "block", "source", "term", "p", "kept"]
    spread = lambda df: (df.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("s_blocks") - 1)))
                         .withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).select(*place))
    cells = spread(shares.withColumn("tb", F.pmod(F.xxhash64("term"), F.col("t_blocks")).cast("int"))).unionByName(spread(
        groups.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)))
        .withColumn("term", F.lit(None).cast("string"))
        .withColumn("p", F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0).cast("long")))))
    sums = (cells.groupBy("lang", "tb", "i", "j").applyInArrow(_pair_sums, "lang string, a string, b string, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    sums = stage(sums, "pairs")
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    q = _share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))
    apart = shares.withColumn("value", F.col("p") - q).where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    both = ranked(pairs, "pair").unionByName(ranked(apart, "term").where(F.col("rank") <= top))
    return both.select("lang", "source", "part", "item", "value", "rank")
