"""What the operators of this subpackage share: scratch tables, worker paths, bounded samples."""

from __future__ import annotations

import os
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, fresh, materialize, scratch_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


BATCH = 8 << 20  # bytes of an Arrow batch to a Python worker; a single row may be longer


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it by sys.path alone, and bounds the batches that they get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int):
    """crc32 of an id written as text, modulo n: the split that the folds of a classifier use."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def folds(col: str, n: int, held_out: int):
    """Whether a row is held out: the crc32 of its id is that remainder modulo n. A null id is not."""
    return F.coalesce(crc_mod(col, n) == held_out, F.lit(False))


def hash_fraction(col: str, n: int, of: int):
    """True for about n of `of` rows, chosen by a hash of col: the same rows in every run and plan."""
    share = Fraction(1) if of <= n else Fraction(n, of)
    return F.pmod(F.xxhash64(F.col(col), F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


__all__ = ["crc_mod", "discard", "folds", "fresh", "hash_fraction", "materialize", "scratch_dir", "ship", "table"]
