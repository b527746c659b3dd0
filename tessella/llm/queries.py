"""The queries of this subpackage, as the driver registers them: thin calls with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, licenses, media, ngram_join, packing, quality, secrets, token_counts, toxicity, vector_codes, warc, whitening
from .oracles import VECTOR_CODES, WARC
from .runtime import folds, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images: each row of embeddings is rendered as one."""
    return media.media_copies(media.render(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "media_id", "image")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.language_id(docs, ~folds("doc_id", 4, 2))
    return out.select("doc_id", folds("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: a source is a tree, 1000 ids a package, 50 ids a folder, the first of each its LICENSE."""
    i = F.col("doc_id")
    name = F.when(i % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("d"), i.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.lit(""), "source", F.concat(F.lit("p"), F.floor(i / 1000).cast("string")), F.concat(F.lit("m"), F.floor(i / 50).cast("string")), name)
    return licenses.license_scan(table(spark, sf_dir, "documents").withColumn("path", path))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels.where(~folds("doc_id", 5, 0))))
    return out.select("doc_id", folds("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.score(docs, quality.fit(docs, labels.where(~folds("doc_id", 5, 0))))
    return out.select("doc_id", folds("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_ngram_join, op3_media, op4_language, op5_licenses, op6_token_counts, op7_toxicity, op8_packing, op9_secrets, op10_quality, op11_warc, op12_whitening, op13_vector_codes)}

#: DuckDB SQL, where it can express the result.
ORACLES: dict[str, str] = {"op11_warc": WARC, "op13_vector_codes": VECTOR_CODES}
