"""Session access, table loading and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_own_dirs: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local, a temporary folder of this process takes its place; on a
    cluster its absence is an error, since a machine-local folder would not be seen by the other executors.
    """
    named = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
        held = tempfile.TemporaryDirectory(prefix="graphloom-")
        _held.append(held)
        _own_dirs[app] = f"file://{held.name}"
    return _own_dirs[app]


_held: list[tempfile.TemporaryDirectory] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when this process ends or the ``scratch_scope`` around it is left."""
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    _written.append((jvm, conf, path))
    return path


_written: list[tuple] = []


def _delete(jvm, conf, pattern: str) -> int:
    """Delete the files and folders a pattern names; how many they were."""
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(conf)
    found = [entry.getPath() for entry in fs.globStatus(at) or []]
    return sum(bool(fs.delete(one, True)) for one in found)


def remove(spark: SparkSession, pattern: str) -> int:
    """Delete the files and folders that ``pattern`` names, wherever they are stored; how many they were."""
    return _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), pattern)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """What is written to scratch paths inside is removed at the end; results that read it must be taken before."""
    mark = len(_written)
    try:
        yield
    finally:
        while len(_written) > mark:
            _delete(*_written.pop())


@atexit.register
def _remove_scratch() -> None:
    for written in _written:
        try:
            _delete(*written)
        except Exception:  # the session may be gone; the folder then outlives it
            return


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage without keeping anything on a single executor: the rows are re-read from the shared folder
    after any loss. Used where one intermediate feeds several later passes.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
