import re

import corpus_pipeline
from liveness.session import table

from conftest import SMALL

from .cases import docs
from .test_decontamination import brute as leaks
from .test_exact_dedup import brute as copies
from .test_mixing import WORD, brute_targets
from .test_near_dedup import brute as near


def test_every_stage_against_brute_force(spark):
    """Each stage is judged on what its predecessor kept (whole tables, sf0.001)."""
    frame = table(spark, SMALL, "documents")
    columns = frame.columns
    benchmark = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "minhash near-dedup", "benchmark decontamination", "mixing sources"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        data = sorted((tuple(r) for r in frame.collect()), key=lambda r: r[0])
        out = stage(spark, frame, SMALL).cache()
        got = sorted(r.doc_id for r in out.collect())
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
            lost = {r[0] for r in data} - set(got)
            good = {i for i, q in labels.items() if q == 1}
            assert len(lost & good) <= 0.03 * len(good) and len(lost) <= 0.2 * len(data)
        elif name == "exact dedup":
            assert got == sorted({keep for _, keep, _, _ in copies(data)})
        elif name == "minhash near-dedup":
            assert got == sorted({c for _, _, c, _ in near(data, 2)})
        elif name == "benchmark decontamination":
            assert got == sorted(r[0] for r in leaks(data, benchmark) if not r[5])
        else:
            sizes = {}
            for r in data:
                sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
            targets = brute_targets(sizes)
            source = {r[0]: r[3] for r in data}
            assert got == sorted(source)
            assert all(abs(r.target - targets[source[r.doc_id]]) < 1e-6 for r in out.collect())
        if k < len(names) - 1:
            assert out.columns == columns
        frame = spark.createDataFrame(out.collect(), out.schema)


def test_empty_documents(spark):
    frame = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SMALL)
        assert frame.count() == 0


def test_null_texts_and_repeated_ids(spark):
    """Rows with nulls, empty texts and repeated ids pass every stage; extra columns stay until the mix."""
    frame = docs(spark).withColumnRenamed("n_chars", "n_chars").selectExpr("*", "'x' AS size", "1 AS kept", "'y' AS id")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = frame.columns
        frame = stage(spark, frame, SMALL)
        if k < 4:
            assert frame.columns == columns
    got = [r.doc_id for r in frame.collect()]
    assert got.count(None) == 2 and 9 not in got and 10 in got


def test_a_run_deletes_only_its_own_stages(spark):
    from liveness.llm.common import stage
    other = stage(spark.range(5), "other")
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert other.count() == 5


def test_no_import_guard_outside_the_entry():
    for path in ("corpus_pipeline.py",):
        assert not re.search("except.*ImportError", open(path).read())
