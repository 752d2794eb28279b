"""Session helpers: building a local session for tests/bench and locating the
shared folder for lineage cuts (``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_LOCAL_STAGE_ROOT: str | None = None


def build_session(master: str | None = None, app: str = "liveness",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on and settings suited to many small source files.

    On a cluster the caller's session is used as is; this is for tests and bench.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.maxFields", "1000")
        .config("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _conf(spark: SparkSession, key: str) -> str | None:
    try:
        v = spark.sparkContext.getConf().get(key, None)
        if v:
            return v
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Spark Connect)
        pass
    try:
        return spark.conf.get(key, None)
    except Exception:  # noqa: BLE001 - unset static conf raises on some versions
        return None


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Spark Connect)
        return int(_conf(spark, "spark.default.parallelism") or _conf(spark, "spark.sql.shuffle.partitions") or 8)


def stage_root(spark: SparkSession) -> str:
    """Shared folder for written stages.

    Uses ``spark.checkpoint.dir`` when the cluster names one. Only when it is unset and
    Spark runs inside one process (``local[...]``, as in tests) a private folder is created
    and registered as checkpoint dir; on a cluster executors would not see it, so that raises.
    """
    global _LOCAL_STAGE_ROOT
    conf_dir = _conf(spark, "spark.checkpoint.dir")
    if conf_dir:
        return conf_dir.rstrip("/")
    master = _conf(spark, "spark.master") or ""
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master!r})")
    if _LOCAL_STAGE_ROOT is None:
        _LOCAL_STAGE_ROOT = tempfile.mkdtemp(prefix="liveness-stage-")
        try:
            spark.sparkContext.setCheckpointDir(os.path.join(_LOCAL_STAGE_ROOT, "rdd"))
        except Exception:  # noqa: BLE001 - no SparkContext (e.g. Spark Connect)
            pass
    return _LOCAL_STAGE_ROOT


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the stage folders that were made inside the block: for a job that has written its
    results by then (``with scratch(spark): analyze_corpus(...)[0].write.parquet(...)``). What other
    jobs of the session have staged stays."""
    own: list[str] = []
    token = _scratch.set(own)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in own:
            delete_path(spark, path)


def new_stage_path(spark: SparkSession, name: str) -> str:
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if (own := _scratch.get()) is not None:
        own.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared stage folder and reading it back.

    Used where a stage is consumed several times (extraction output) so that a lost
    executor re-reads Parquet instead of re-running the Python pass.
    """
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, the file system that holds it)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a staged folder, through the file system that holds it."""
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


def replace_path(spark: SparkSession, path: str, target: str) -> None:
    """Move a folder to ``target``, in place of what is there."""
    p, fs = file_system(spark, path)
    t, _ = file_system(spark, target)
    fs.delete(t, True)
    if not fs.rename(p, t):
        raise OSError(f"could not rename {path} to {target}")


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names inside a folder of any Hadoop file system; none if it does not exist."""
    p, fs = file_system(spark, folder)
    return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    p, fs = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with ``text``; False, and nothing changed, if there is one already. The
    file system refuses the second of two writers."""
    p, fs = file_system(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def release(*frames: DataFrame) -> None:
    """Delete the folders of staged tables once nothing reads them any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
