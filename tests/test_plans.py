"""Plan checks: newest-N is a TakeOrdered, counts aggregate partially before the
shuffle, filters and column pruning reach the scan, and no Python runs in any operator
other than the extraction pass."""

import pytest

from conftest import SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "PythonMapInArrow", "MapInPandas",
                "FlatMapGroupsInPandas", "PythonUDF")
# queries whose plan legitimately contains the Arrow extraction pass or the name automata (or that
# only read back a staged extraction / a written sink)
USES_PARSER = {"analyze_corpus", "analyze_corpus_texts", "symbol_named_in_text", "answer_questions", "expand_answer", "extract_entities", "extract_calls", "call_counts_corpus",
               "cyclomatic_complexity", "class_method_count", "dynamic_call_risk", "entity_snippet",
               "parse_errors", "stream_score_files", "append_analysis", "project_summary_of_run"}


def _queries():
    from liveness.plans.registry import QUERIES, load_all
    load_all()
    return QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_n_is_take_ordered(spark):
    from __spark_entry__ import queries
    assert "TakeOrderedAndProject" in _plan(queries()["recent_removals"](spark, SMALL))


def test_counts_aggregate_partially(spark):
    from __spark_entry__ import queries
    p = _plan(queries()["call_counts"](spark, SMALL))
    assert "partial_count" in p


def test_filter_and_pruning_reach_scan(spark):
    from __spark_entry__ import queries
    p = _plan(queries()["parse_xai_json"](spark, SMALL))
    assert "In(l_returnflag, [A,R])" in p and "EqualTo(l_returnflag,R)" in p
    # only the needed lineitem columns are read
    assert "l_extendedprice" not in p and "l_shipdate" not in p


def _native_names():
    return sorted(n for n in _queries() if n not in USES_PARSER)


@pytest.mark.parametrize("name", _native_names())
def test_native_operators_have_no_python(spark, name):
    plan = _plan(_queries()[name](spark, SMALL))
    assert not any(node in plan for node in PYTHON_NODES), name
