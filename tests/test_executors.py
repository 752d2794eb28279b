"""Executors have no copy of the package: queries with Python in their tasks run in a driver that alone can import it."""

import os
import subprocess
import sys

from conftest import SMALL
from test_plans import USES_PARSER

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
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
from liveness.plans.registry import QUERIES, load_all
load_all()
for name in sys.argv[1:]:
    QUERIES[name](spark, {SMALL!r}).count()
    print("ran", name)
"""


def test_queries_run_without_the_package_on_executors(tmp_path):
    names = sorted(USES_PARSER | {"scan_files"})
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, *names], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == len(names)
