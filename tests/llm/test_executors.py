"""Executors have no copy of the package: every query runs in a driver that alone can import it."""

import os
import subprocess
import sys

import pytest

from conftest import SMALL

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

def found(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({{"there": [importlib.util.find_spec("liveness") is not None]}})

assert not spark.range(1).mapInArrow(found, "there boolean").first()[0], "the executors have the package"
from __spark_entry__ import queries
for name, run in queries().items():
    if name.startswith(sys.argv[1]) or name == sys.argv[1]:
        assert run(spark, {SMALL!r}).count() > 0, name
        print("ran", name)
"""


@pytest.mark.parametrize("which", ["op", "pipeline"])
def test_queries_run_without_the_package_on_executors(tmp_path, which):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, which], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == (13 if which == "op" else 1)
