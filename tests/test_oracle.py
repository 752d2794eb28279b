"""The correctness gate at sf0.001: every query with an oracle SQL equals DuckDB."""

import math

import duckdb
import pyarrow as pa
import pytest

from conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 9) if not math.isnan(v) else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _kind(t):
    """A type as text; lists by their value type, as the inner field's name differs between engines."""
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{_kind(t.value_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ", ".join(f"{t.field(i).name}: {_kind(t.field(i).type)}" for i in range(t.num_fields)) + ">"
    return str(t)


def _rows(t, cols):
    d = t.to_pydict()
    return sorted((tuple(_norm(d[c][i]) for c in cols) for i in range(t.num_rows)),
                  key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def _registry():
    from liveness.plans.registry import ORACLE, QUERIES, load_all
    load_all()
    return QUERIES, ORACLE


def _names():
    return sorted(_registry()[1])


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    queries, oracle = _registry()
    st = queries[name](spark, SMALL).toArrow()
    dt = con.sql(oracle[name]).to_arrow_table()
    cols = sorted(st.column_names)
    assert cols == sorted(dt.column_names)
    assert {f.name: _kind(f.type) for f in st.schema} == {f.name: _kind(f.type) for f in dt.schema}
    assert _rows(st, cols) == _rows(dt, cols)


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0


def test_every_query_has_an_oracle():
    queries, oracle = _registry()
    assert set(queries) == set(oracle)
