"""Queries on incremental runs and published generations (families B and S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental
from ..scratch import fresh
from ..sources import generations
from .registry import query
from .tables import table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def quotes(stop_after: int | None = None):
    """A stand-in for an external model: upper-case quotes, which are seldom literal, and literal ones after feedback."""
    calls = []

    def work(rows):
        calls.append(1)
        if stop_after is not None and len(calls) > stop_after:
            raise incremental.StopRun("credential refused")
        literal = F.substring("text", 1, 40)
        return rows.select("input_hash", F.when(F.size("feedback") == 0, F.upper(literal)).otherwise(literal).alias("output"))

    return work


@query(
    "with q as (select doc_id, substr(text, 1, 40) as lit, upper(substr(text, 1, 40)) as up, text from documents), j as (select doc_id, lit, up, coalesce(contains(text, up) and length(up) >= 40, false) as first_ok, coalesce(length(lit) >= 40, false) as then_ok from q)"
    " select doc_id, case when first_ok or then_ok then 'ok' else 'invalid' end as status, case when first_ok then up when then_ok then lit end as quote, case when first_ok then 1 else 2 end as attempts from j"
)
def incremental_run(spark, d):
    """Work on distinct inputs by a ledger: a run that stops after a few batches, one that goes on where it stopped, retries with feedback."""
    docs, path = table(spark, d, "documents"), fresh(spark, "io", "ledger")
    config = {"model": "quotes", "version": "1"}
    errors = F.array_compact(F.array(F.when(~F.col("text").contains(F.col("output")), "not in the text"), F.when(F.length("output") < 40, "short")))
    for work in (quotes(3), quotes()):
        incremental.run(docs, ["text"], work, path, config, errors, retries=1, batches=4)
    return incremental.results(docs, ["text"], path, config, errors).select("doc_id", "status", F.col("output").alias("quote"), "attempts")


class Stopped(RuntimeError):
    pass


def _stop(name: str):
    if name == "commit":
        raise Stopped(name)


@query(" union all ".join(f"select '{t}' as name, count(*) as n_rows, true as whole from {t}" for t in TABLES))
def published_generation(spark, d):
    """All tables published as a generation; a second writer stops before its commit, and readers still see the first, whole."""
    root = fresh(spark, "io", "library")
    generations.publish(spark, root, {t: table(spark, d, t) for t in TABLES}, "first")
    try:
        generations.publish(spark, root, {"region": table(spark, d, "region")}, "second", step=_stop)
    except Stopped:
        pass
    whole = generations.verify(spark, root)
    read = [generations.read(spark, root, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("name"), "n_rows", F.lit(ok).alias("whole")) for t, ok in whole.items()]
    out = read[0]
    for r in read[1:]:
        out = out.unionByName(r)
    return out
