"""The derived source corpus is the same text in Spark and in the oracle SQL."""

import duckdb

from conftest import SMALL


def test_corpus_text_equals_sql(spark):
    from liveness.plans.corpus import corpus_files
    from liveness.plans.views import with_views
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    sql = dict(con.execute(with_views("SELECT rel_path, content FROM corpus_files", "corpus_files")).fetchall())
    got = {r.rel_path: r.content for r in corpus_files(spark, SMALL).select("rel_path", "content").collect()}
    assert got == sql and len(got) > 100


def test_appended_rows_all_come_back(spark):
    from liveness.plans import views as V
    from liveness.plans.registry import QUERIES, load_all
    load_all()
    large = SMALL.replace("sf0.001", "sf0.01")
    for name, source in (("append_chat", V.chat_history), ("append_removals", V.removal_logs)):
        back, want = QUERIES[name](spark, large), source(spark, large).count()
        assert want > 50 and back.count() == want and {"id", "timestamp"} <= set(back.columns)
