"""Runs that do costly work on each distinct input once, through failures, restarts and retries.

A ledger keeps one row per input hash that was worked on. Its folders are batches; a batch is named by
a hash of what it holds, so one that is written again takes its own place and none counts twice, and a
folder without Spark's success mark doesn't count at all. What to do is an anti-join of the inputs
with the ledger; only names of batches and their counts come to the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize
from ..sources import files

LEDGER = "input_hash string, status string, output string, attempts int, errors array<string>"


class StopRun(RuntimeError):
    """Raised by the work when going on makes no sense, as where a credential is refused. Ends the run, not the program."""


@dataclass
class Report:
    """Distinct inputs: known before, worked on now; batches: started, not started; why the run ended early."""

    known: int
    worked: int
    started: int
    unstarted: int
    stopped: str | None


def input_hash(config: dict[str, str], inputs: list[str]) -> Column:
    """SHA-256 of the inputs by name and of what else an output depends on, such as versions."""
    fixed = F.lit(json.dumps(config, sort_keys=True, ensure_ascii=False))
    return F.sha2(F.to_json(F.struct(fixed.alias("config"), F.struct(*sorted(inputs)).alias("input")), {"ignoreNullFields": "false"}), 256)


def read_ledger(spark, path: str) -> DataFrame:
    """The rows of all finished batches."""
    done = [f"{path}/{n}" for n in files.names(spark, path) if n.startswith("batch-") and files.exists(spark, f"{path}/{n}/_SUCCESS")]
    return spark.read.schema(LEDGER).parquet(*done) if done else spark.createDataFrame([], LEDGER)


def distinct_inputs(items: DataFrame, inputs: list[str], config: dict[str, str]) -> DataFrame:
    return items.select(*inputs).withColumn("input_hash", input_hash(config, inputs)).dropDuplicates(["input_hash"])


def trusted(wanted: DataFrame, ledger: DataFrame, errors: Column) -> DataFrame:
    """(input_hash, output, attempts) of wanted inputs whose output in the ledger holds today's checks; of several the first by order."""
    ok = wanted.join(ledger.where("status = 'ok'").select("input_hash", "output", "attempts"), "input_hash").where(F.size(errors) == 0)
    return ok.groupBy("input_hash").agg(F.min(F.struct("attempts", "output")).alias("best")).select("input_hash", "best.output", "best.attempts")


def judge(rows: DataFrame, work: Callable[[DataFrame], DataFrame], errors: Column) -> DataFrame:
    """rows with output and errors; a row that the work gives nothing for, or gives twice, has an error."""
    out = work(rows).groupBy("input_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("output").alias("output"))
    found = rows.join(out, "input_hash", "left").withColumn("errors", F.when(F.col("output").isNull(), F.array(F.lit("no output"))).when(F.col("_n") > 1, F.array(F.lit("several outputs"))).otherwise(errors))
    return found.drop("_n")


def work_batch(todo: DataFrame, work: Callable[[DataFrame], DataFrame], errors: Column, retries: int) -> DataFrame:
    """The ledger's rows for a batch. What fails its checks is worked on again with the errors as feedback, `retries` times at most."""
    inputs = [c for c in todo.columns if c != "input_hash"]
    pending, done = todo.withColumn("feedback", F.expr("cast(array() as array<string>)")), None
    for attempt in range(1, retries + 2):
        good = F.size("errors") == 0
        last = attempt > retries
        judged = judge(pending.withColumn("attempt", F.lit(attempt)), work, errors)
        # Only what is worked on again keeps its inputs.
        kept = [F.when(~good & F.lit(not last), F.col(c)).alias(c) if c in inputs else F.col(c) for c in judged.columns]
        judged = materialize(judged.select(*kept), "incremental-try")
        row = judged.where(F.lit(True) if last else good).select("input_hash", F.when(good, "ok").otherwise("invalid").alias("status"), "output", F.lit(attempt).alias("attempts"), "errors")
        done = row if done is None else done.unionByName(row)
        if last or judged.where(~good).isEmpty():
            break
        pending = judged.where(~good).drop("feedback", "attempt", "output").withColumnRenamed("errors", "feedback")
    return done


def run(items: DataFrame, inputs: list[str], work: Callable[[DataFrame], DataFrame], path: str, config: dict[str, str] | None = None, errors: Column | None = None, retries: int = 1, batches: int = 8, cost: Column | None = None, budget: float | None = None) -> Report:
    """Works on every distinct input of items that the ledger at path doesn't hold, batch by batch.

    work takes rows (input_hash, the inputs, attempt, feedback) and gives (input_hash, output), output
    a string; errors is a column, an array of strings, over the inputs and `output`. Null inputs are
    values. Outputs are kept under their hash of inputs and config: another config works anew. Rows of
    the ledger are checked again, so a ledger that was tampered with, or checks that have become
    stricter, make work. What stays invalid is kept with its errors and is worked on again by the next
    run. A batch whose cost times all its attempts exceeds what is left of the budget isn't started.
    An exception of the work ends the run with what earlier batches have written; StopRun ends it
    quietly. Repeated rows are worked on once; no items make no batch.
    """
    spark, config = items.sparkSession, config or {}
    errors = F.expr("cast(array() as array<string>)") if errors is None else errors
    wanted = materialize(distinct_inputs(items, inputs, config), "incremental-inputs")
    held = read_ledger(spark, path)
    known = trusted(wanted, held, errors)
    bucket = F.pmod(F.conv(F.substring("input_hash", 1, 8), 16, 10).cast("long"), F.lit(batches)).cast("int")
    # With nothing in the ledger all that is wanted is to do, and isn't written again.
    todo = wanted.withColumn("bucket", bucket) if held.isEmpty() else materialize(wanted.join(known.select("input_hash"), "input_hash", "left_anti").withColumn("bucket", bucket), "incremental-todo")
    number = F.sum(F.conv(F.substring("input_hash", 9, 15), 16, 10).cast("decimal(38,0)"))
    plan = todo.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), number.alias("sum"), F.sum(cost if cost is not None else F.lit(0.0)).cast("double").alias("cost")).orderBy("bucket").collect()  # `batches` rows at most
    total, planned = wanted.count(), sum(r["n"] for r in plan)
    report = Report(total - planned, 0, 0, 0, None)
    spent = 0.0
    for r in plan:
        worst = (r["cost"] or 0.0) * (retries + 1)
        if report.stopped is None and budget is not None and spent + worst > budget:
            report.stopped = "budget"
        if report.stopped is not None:
            report.unstarted += 1
            continue
        name = "batch-" + hashlib.sha256(f"{sorted(config.items())}/{r['n']}/{r['sum']}".encode()).hexdigest()[:24]
        report.started += 1
        try:
            done = work_batch(todo.where(F.col("bucket") == r["bucket"]).drop("bucket"), work, errors, retries)
            # Written whole under its own name: a restart after a stop in the middle writes the same rows in the same place.
            done.write.mode("overwrite").parquet(f"{path}/{name}")
        except StopRun as e:
            report.stopped = str(e) or "stopped"
            continue
        spent += r["cost"] or 0.0
        report.worked += r["n"]
    discard(wanted, todo)
    return report


def results(items: DataFrame, inputs: list[str], path: str, config: dict[str, str] | None = None, errors: Column | None = None) -> DataFrame:
    """items with status (ok, invalid, pending), output, attempts and errors, each row of items once."""
    config = config or {}
    errors = F.expr("cast(array() as array<string>)") if errors is None else errors
    ledger = read_ledger(items.sparkSession, path)
    wanted = distinct_inputs(items, inputs, config)
    good = trusted(wanted, ledger, errors).select("input_hash", F.lit("ok").alias("status"), "output", "attempts", F.expr("cast(array() as array<string>)").alias("errors"))
    bad = ledger.where("status = 'invalid'").join(good.select("input_hash"), "input_hash", "left_anti")
    bad = bad.groupBy("input_hash").agg(F.max(F.struct("attempts", "output", "errors")).alias("last")).select("input_hash", F.lit("invalid").alias("status"), F.lit(None).cast("string").alias("output"), "last.attempts", "last.errors")
    found = good.unionByName(bad)
    rows = items.withColumn("input_hash", input_hash(config, inputs)).join(found, "input_hash", "left")
    return rows.withColumns({"status": F.coalesce("status", F.lit("pending")), "attempts": F.coalesce("attempts", F.lit(0))}).drop("input_hash")


def compact(spark, path: str, config: dict[str, str] | None = None) -> int:
    """Writes the rows of all finished batches as one and removes the old ones; the number of batches before.

    Readers that come between the two steps see rows twice, which trusted() makes one."""
    old = [n for n in files.names(spark, path) if n.startswith("batch-")]
    whole = [n for n in old if files.exists(spark, f"{path}/{n}/_SUCCESS")]
    if len(whole) > 1:
        name = "batch-" + hashlib.sha256("/".join(whole).encode()).hexdigest()[:24]
        read_ledger(spark, path).dropDuplicates(["input_hash", "status"]).write.mode("overwrite").parquet(f"{path}/{name}")
        for n in old:
            files.delete(spark, f"{path}/{n}")
    return len(whole)
