"""The corpus pipeline: toxicity, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All stages but the last return the columns
of documents, and whatever further columns docs have, under any names. All take an empty table (and
give none, or an empty one), texts of any length, and rows with nulls: a null text counts as an empty
one, a null id as an id of its own, a null n_chars or source as nothing at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, ngram_join, packing, secrets, toxicity
from tessella.llm.queries import tokenizer_path
from tessella.llm.runtime import folds, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; one pass scores and keeps the columns.

    A score depends on the text alone, so repeated rows go or stay together; null and empty texts stay
    unless the model calls an empty text toxic.
    """
    labels = table(spark, sf_dir, "labels").where(~folds("doc_id", 5, 0))
    return toxicity.clean_rows(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id stays, null ids last.

    Of repeated rows one stays. Null texts and texts without a word have no duplicates and all stay.
    """
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text; null and empty texts stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in the text (n_chars, where there is one, follows); every row stays, null texts as nulls."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces in sequences of 2048 tokens; an empty or null text is its end id alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("packing", pack_sequences)]

#: SQL can't express a learned score, nor packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
