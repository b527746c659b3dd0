"""Search from request to answer, for many requests at once: understood, filtered, scored, ranked, summed up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import understanding as U
from ..scratch import materialize
from . import score

BLOCK = 500  # requests that go to every task at once; more go in blocks
LIMIT, MOST, LEAST_SCORE = 12, 50, 0.12


def understood(requests: DataFrame) -> DataFrame:
    """requests(id, query, subjects, bands, expansion, limit) with what the text asks for.

    Adds asked, gone, its bands and core terms, the subjects and bands that hold (those of the request
    itself before those of its text), the expansion terms that share a topic, and the limit within 1 to
    50. subjects, bands and expansion are arrays and may be null, as may the limit; a null query is empty.
    """
    none = F.array().cast("array<string>")
    q = F.coalesce("query", F.lit(""))
    asked, gone = U.subjects_of(q)
    given = lambda c: F.coalesce(F.col(c), none)
    rows = requests.select("id", q.alias("query"), given("subjects").alias("_subjects"), given("bands").alias("_bands"), given("expansion").alias("_more"), F.coalesce("limit", F.lit(LIMIT)).alias("_limit"), asked.alias("asked"), gone.alias("gone"), U.bands_of(q).alias("text_bands"), U.core_terms(q).alias("core"))
    pick = lambda own, text: F.when(F.size(own) > 0, F.array_distinct(own)).otherwise(F.col(text))
    return rows.select("id", "query", "gone", "core", pick(F.col("_subjects"), "asked").alias("subjects"), pick(F.col("_bands"), "text_bands").alias("bands"), U.anchored(F.transform("_more", lambda t: F.lower(t)), F.col("core")).alias("more"), F.greatest(F.lit(1), F.least(F.lit(MOST), "_limit")).alias("limit"))


def _matches(subject, band):
    """The hard filters of an understood request against a record's subject and band."""
    open_or = lambda c, value: (F.size(c) == 0) | F.array_contains(F.col(c), value)
    return open_or("subjects", subject) & ~F.array_contains("gone", subject) & open_or("bands", band)


def _scored(records: DataFrame, asked: DataFrame, fields: list[str]) -> DataFrame:
    """(id, code, match_strength, score) of records that pass a request's filters and are relevant to it."""
    subject, band = F.coalesce("subject", F.lit("")), F.coalesce("band", F.lit(""))
    # A block of requests, bounded by BLOCK, against all records: every record is read once a block.
    lowered = records.withColumns({f: F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields})
    pairs = lowered.join(F.broadcast(asked.select("id", "subjects", "gone", "bands", "core", "more", "limit")), _matches(subject, band))
    found = score.relevance(pairs, fields, F.col("core"), F.col("more"), lowered=True)
    return found.where((F.col("match_strength") != "irrelevant") & (F.col("score") >= LEAST_SCORE)).select("id", "code", "match_strength", "score", "limit")


def smart_search(records: DataFrame, requests: DataFrame, fields: list[str]) -> DataFrame:
    """A row per request: id, subjects, excluded, bands, core, sentence, total_candidates, relevant, direct, supporting, omitted, note, codes.

    records(code, subject, band, fields); codes are the best `limit` by score (to four places), then by
    code. Candidates pass the hard filters; only those with evidence of the topic are answers, and a
    short answer isn't filled up: note says none, fewer, all or first of more than the limit.
    """
    asked = materialize(understood(requests), "search-requests")
    blocks = max(1, -(-asked.count() // BLOCK))
    part = lambda k: asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
    relevant = materialize(reduce(DataFrame.unionByName, [_scored(records, part(k), fields) for k in range(blocks)]), "search-relevant")
    # How many pass the filters is known from the number of records by subject and band.
    cells = records.groupBy(F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("band", F.lit("")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumnsRenamed({"subject": "_s", "band": "_b"})
    totals = cells.join(F.broadcast(asked) if blocks == 1 else asked, _matches(F.col("_s"), F.col("_b"))).groupBy("id").agg(F.sum("n").alias("total"))
    strength = lambda name: F.count_if(F.col("match_strength") == name).alias(name)
    counts = relevant.groupBy("id").agg(F.count(F.lit(1)).alias("relevant"), strength("direct"), strength("supporting"))
    ranked = relevant.withColumn("points", F.floor(F.col("score") * 10000 + 0.5))
    w = Window.partitionBy("id").orderBy(F.desc("points"), "code")
    # The limit is 50 at most, so Spark keeps as many of each task before it shuffles.
    best = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST).where(F.col("rank") <= F.col("limit"))
    best = best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda r: r["code"]).alias("codes"))
    out = asked.join(totals, "id", "left").join(counts, "id", "left").join(best, "id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    note = F.when(n("relevant") == 0, "none").when(n("relevant") < F.col("limit"), "fewer").when(n("relevant") > F.col("limit"), "first").otherwise("all")
    sentence = U.humanized(F.col("bands"), F.col("subjects"), F.col("gone"), F.array().cast("array<string>"))
    kind = F.array().cast(f"array<{records.schema['code'].dataType.simpleString()}>")
    return out.select("id", "subjects", F.col("gone").alias("excluded"), "bands", "core", sentence.alias("sentence"), n("total").alias("total_candidates"), n("relevant").alias("relevant"), n("direct").alias("direct"), n("supporting").alias("supporting"), (n("total") - n("relevant")).alias("omitted"), note.alias("note"), F.coalesce("codes", kind).alias("codes"))


__all__ = ["smart_search", "understood"]
