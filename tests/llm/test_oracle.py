"""The registered queries against their DuckDB SQL, and the entry without the subpackage."""

import subprocess
import sys

import duckdb
import pytest

from liveness.llm.queries import ORACLE, QUERIES

from conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = QUERIES[name](spark, SMALL).toArrow(), con.sql(ORACLE[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    flat = lambda t: sorted(zip(*[t[c].to_pylist() for c in columns]), key=repr)
    assert flat(got) == flat(want)


def test_entry_works_without_the_subpackage():
    code = ("import sys; sys.modules['liveness.llm'] = None\n"
            "import __spark_entry__ as e\n"
            "assert 'pipeline' not in e.queries() and not any(n.startswith('op1') for n in e.queries())\n"
            "assert 'call_counts' in e.queries() and 'call_counts' in e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True)
