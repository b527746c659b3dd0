"""Small files and folders on any file system that Spark reaches, through Hadoop's own classes."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, by name; nothing where there is no such folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; None where there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON object; None where there is none or it isn't whole."""
    text = read_text(spark, path)
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def create(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> bool:
    """Writes a small file to the disk; False where it is there already (a store must make that check itself to exclude other writers, as HDFS does)."""
    fs, p = _at(spark, path)
    try:
        stream = fs.create(p, overwrite)
    except Exception as e:
        if not overwrite and fs.exists(p):
            return False
        raise e
    try:
        stream.write(bytearray(text.encode()))
        stream.hsync()
    finally:
        stream.close()
    return True


def move(spark: SparkSession, source: str, to: str) -> bool:
    """Renames a file or folder; False where the source is gone or the target is there."""
    fs, p = _at(spark, source)
    _, q = _at(spark, to)
    fs.mkdirs(q.getParent())
    return not fs.exists(q) and fs.exists(p) and fs.rename(p, q)


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place of another in one step: a reader sees the old one or the new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    create(spark, f"{path}.new", text, overwrite=True)
    option = hadoop.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = option
    p = hadoop.Path(path)
    hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(hadoop.Path(f"{path}.new"), p, options)
