"""Tables written once in the session's shared folder, so that lineage ends and a lost executor costs nothing."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may do without; it then gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessella_")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark: SparkSession, kind: str, name: str) -> str:
    """A path of its own in the shared folder. Within scope() it goes when the scope ends."""
    path = f"{scratch_dir(spark)}/{kind}/{name}-{uuid.uuid4().hex}"
    for s in _scopes:
        s.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end whatever has been written by fresh() and materialize() within it.

    A result is lazy and reads such tables, so it must be written or collected before the scope ends."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back. (checkpoint() would run the last stage twice.)"""
    spark = df.sparkSession
    path = fresh(spark, "tables", name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() has made and that nothing reads any more."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            delete(t.sparkSession, path)
