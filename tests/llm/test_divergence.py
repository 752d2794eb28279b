"""Source divergence against a dense definition over all terms and sources."""

import random
import re
from collections import Counter, defaultdict

import pytest

from liveness.llm import divergence
from liveness.llm.divergence import source_divergence, terms

from .cases import DOCS, ROWS, clashing, docs, lower, rows

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def expected(table, least=30, top=50):
    count, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in table:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", lower(text))
        count[lang, source].update(found)
        in_docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, values, last in (("pair", pair, None), ("term", term, top)):
                order = sorted(values, key=lambda v: (-v[0], v[1].encode()))[:last]
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(order, 1)]
    return sorted(out, key=repr)


def some_docs(n=150, sources=9):
    rng = random.Random(2)
    vocabulary = [f"w{'abcdefghij'[i % 10] * (i // 10 + 1)}é" for i in range(60)]
    out = []
    for i in range(n):
        k = rng.randrange(sources)
        liked = vocabulary[k * 5:k * 5 + 20]
        out.append((i, rng.choice([" ", ", ", "1"]).join(rng.choices(vocabulary + liked * 4, k=rng.randint(0, 60))).title(),
                    rng.choice(["en", "en", "fr", None]), rng.choice([f"s{k}", f"S{k}", None]), 0))
    return out + [(900, None, "none", "x", 0), (901, "few words", "none", "y", 0), (902, "", "en", "silent", 0)]


@pytest.mark.parametrize(("sources", "block_terms"), [(divergence.SOURCES, divergence.TERMS), (3, 4)])
def test_dense_definition(spark, sources, block_terms):
    table = some_docs()
    got = rows(source_divergence(docs(spark, table), least_docs=8, top=7, sources=sources, block_terms=block_terms), *COLUMNS)
    assert got == expected(table, 8, 7)
    assert {("none", "x", "pair", "y", 0, 1)} <= set(got)


def test_rows_that_every_operator_must_survive(spark):
    assert rows(source_divergence(clashing(docs(spark)), least_docs=1), *COLUMNS) == expected(ROWS, 1)


def test_no_rows(spark):
    assert source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_counts_beyond_a_long(spark):
    """Shares are exact where 10^9 times a count is more than a long holds."""
    count, total = 4 * 10**11 + 1, 9 * 10**11 + 7
    from pyspark.sql import functions as F
    one = spark.range(1).select(F.lit(count).alias("c"), F.lit(total).alias("t"), F.lit(3).cast("long").alias("k"))
    got = one.select(divergence._share(F.col("c"), F.col("t"), F.col("k"))).first()[0]
    assert got == 1 + 10**9 * (count + 5) // (total + 15)


def test_long_text_in_pieces(monkeypatch):
    text = ("Alpha béta,gamma\n" * 300).encode()
    whole = terms(text)
    monkeypatch.setattr(divergence, "_PIECE", 50)
    assert terms(text) == whole == {b"alpha": 300, "béta".encode(): 300, b"gamma": 300}
