"""Tables of a run in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only on a single machine (a local master,
    as in tests) may it be unset: then a temporary folder is made and remembered in the session."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillspark.shared.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("quillspark.shared.dir", where)
    return where.rstrip("/")


_held = threading.local()
_left: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It goes at the end of the innermost temporary(), else when
    the driver ends, since what is lazy may still read it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = getattr(_held, "scopes", None)
    if scopes:
        scopes[-1].append(path)
    else:
        if not _left:
            atexit.register(release, spark)
        _left.append(path)
    return path


@contextmanager
def noted(paths: list[str]):
    """Adds to `paths` what scratch() names inside and outside of temporary()."""
    before = set(_left)
    try:
        yield
    finally:
        paths += [p for p in _left if p not in before]


@contextmanager
def temporary(spark: SparkSession):
    """Deletes what scratch() and materialize() made inside; what is to stay must be written to a path
    taken outside."""
    scopes = _held.scopes = getattr(_held, "scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        delete(spark, scopes.pop())


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that scratch() named."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _left:
            _left.remove(path)


def release(spark: SparkSession) -> None:
    """Delete all that scratch() named outside of temporary(): once the results have been read."""
    try:
        delete(spark, list(_left))
    except Exception:  # the session has ended before the driver
        _left.clear()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, the rows are
    computed once, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
