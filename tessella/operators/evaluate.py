"""Evaluation of predictions, rankings and rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metric, passes while, rolls back when.
ROLLOUT_RULES = [("route_error_rate_delta_pp", "value <= 0.1", "value > 0.3"), ("task_completion_delta_percent", "value >= -2", "value < -5"), ("p75_lcp_ms", "value <= 2500", "value > 3000"), ("p75_inp_ms", "value <= 200", "value > 300"), ("cls", "value <= 0.1", "value > 0.15"), ("graph_fallback_rate_percent", "value < 1", "value >= 3"), ("frontend_exception_delta_percent", "value <= 10", "value > 25")]


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, abstained; a missing prediction is no abstention and misses what was expected."""
    e, p = F.col(expected), F.col(predicted)
    return df.agg(F.count_if(e & (F.coalesce(p, F.lit("")) == "accept")).alias("tp"), F.count_if(~e & (p == "accept")).alias("fp"), F.count_if(e & (F.coalesce(p, F.lit("")) != "accept")).alias("fn"), F.count_if(~e & (F.coalesce(p, F.lit("")) != "accept")).alias("tn"), F.count_if(p == "abstain").alias("abstained"))


def ranking(ranked: DataFrame, query: str, rank: str, good: str, k: int) -> DataFrame:
    """One row: queries, top-1 hits, hits within k, and the sum of reciprocal ranks in millionths."""
    per = ranked.groupBy(query).agg(F.min(F.when(F.col(good), F.col(rank))).alias("r"))
    return per.agg(F.count("*").alias("queries"), F.count_if(F.col("r") == 1).alias("top1"), F.count_if(F.col("r") <= k).alias("recalled"), F.coalesce(F.sum(F.floor(F.lit(1000000) / F.col("r"))), F.lit(0)).cast("long").alias("mrr_millionths"))


def rollout(metrics: DataFrame) -> DataFrame:
    """metrics(stage, metric, value) -> (stage, decision): any rollback rolls back, all passes advance, else hold."""
    status = None
    for name, ok, back in ROLLOUT_RULES:
        verdict = F.when(F.expr(back), 2).when(F.expr(ok), 0).otherwise(1)
        status = F.when(F.col("metric") == name, verdict) if status is None else status.when(F.col("metric") == name, verdict)
    worst = metrics.withColumn("_s", F.when(F.col("value").isNull(), 1).otherwise(status)).groupBy("stage").agg(F.max("_s").alias("_s"))
    return worst.select("stage", F.element_at(F.array(F.lit("advance"), F.lit("hold"), F.lit("rollback")), F.col("_s") + 1).alias("decision"))
