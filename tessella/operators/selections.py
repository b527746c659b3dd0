"""Selections, mappings and small parsers: quotas, exclusions, field sets, declared mappings, evaluation joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import numbered

# The words that count as terms.
LATIN_WORD, HAN_RUN = "[a-z][a-z0-9_-]{2,}", r"[\p{IsHan}]{2,}"
# The names of field sets.
FIELDSETS = ["public", "source", "evidence", "textbook", "admin"]


def fieldsets(value: Column) -> Column:
    """The known field sets of a comma list, in order, repeated ones too; public where there is none."""
    known = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x.isin(FIELDSETS))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("public")))


def exclusions(parts: list[Column], includes: Column) -> Column:
    """The union of all exclusions, each once, without what is asked for explicitly."""
    none = F.array().cast("array<string>")
    whole = F.concat(*[F.coalesce(p, none) for p in parts])
    return F.array_except(F.array_distinct(whole), F.coalesce(includes, none))


def quota(rows: DataFrame, source: str, arrival: list[str], n: int) -> DataFrame:
    """The first n rows of each source by arrival; rows of a null source are one source's."""
    w = Window.partitionBy(source).orderBy(*arrival)
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def limited_by_group(rows: DataFrame, group: list[str], order: Column, n: int) -> DataFrame:
    """At most n rows of each group by order, and all of those numbered anew by the same order, from 1. order has no repeats."""
    w = Window.partitionBy(*group).orderBy("_order")
    kept = rows.withColumn("_order", order).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")
    return numbered(kept, "_order").drop("_order")


def terms(text: Column) -> Column:
    """Latin words of three characters or more and the pairs of neighbouring Han characters, each once. The text is in compatibility form."""
    t = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(t, F.lit(HAN_RUN), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substr(r, k, F.lit(2)))))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(LATIN_WORD), F.lit(0)), pairs))


def evaluated(golden: DataFrame, predictions: DataFrame, order: str) -> DataFrame:
    """golden(candidate, case, multi, ...) with decision and matched_by (candidate, case, missing).

    predictions(candidate, case, decision, order): the last of a candidate counts, and of a case where a
    golden row has no prediction by candidate and isn't one of several candidates of its case."""
    last = lambda key: predictions.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(F.max_by("decision", order).alias(f"_by_{key}"))
    out = golden.join(last("candidate"), F.col("candidate") == F.col("_candidate"), "left").join(last("case"), F.col("case") == F.col("_case"), "left")
    by_case = F.col("_case").isNotNull() & ~F.coalesce("multi", F.lit(False))
    matched = F.when(F.col("_candidate").isNotNull(), "candidate").when(by_case, "case").otherwise("missing")
    decision = F.when(F.col("_candidate").isNotNull(), F.col("_by_candidate")).when(by_case, F.col("_by_case")).otherwise("missing")
    return out.select(*golden.columns, decision.alias("decision"), matched.alias("matched_by"))


def unit_mappings(units: DataFrame, sections: DataFrame, declared: DataFrame) -> DataFrame:
    """(grp, unit, section, method, confidence): declared mappings first, then equal titles, each section once.

    units(grp, unit, ord, title), sections(grp, section, title), declared(grp, unit, section, confidence).
    A declared mapping without its unit or section is a gap (missing_reference). A unit that no
    declared mapping takes gets the one section of its title that is free; the first unit by ord has it
    where several share the title. Several free sections are a gap (ambiguous), none is another
    (no_section); gaps have no section. Titles are compared without case and outer space.
    """
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    u = units.select("grp", "unit", "ord", key("title").alias("title"))
    s = sections.select("grp", "section", key("title").alias("title"))
    told = declared.join(u.select("grp", "unit", F.lit(1).alias("_u")), ["grp", "unit"], "left").join(s.select("grp", "section", F.lit(1).alias("_s")), ["grp", "section"], "left")
    good = F.col("_u").isNotNull() & F.col("_s").isNotNull()
    explicit = told.where(good).select("grp", "unit", "section", F.lit("explicit_manifest").alias("method"), F.col("confidence").cast("double").alias("confidence"))
    lost = told.where(~good).select("grp", F.when(F.col("_u").isNotNull(), F.col("unit")).alias("unit"), F.lit(None).cast(s.schema["section"].dataType).alias("section"), F.lit("missing_reference").alias("method"), F.lit(None).cast("double").alias("confidence"))
    free = s.join(explicit.select("grp", "section"), ["grp", "section"], "left_anti").groupBy("grp", "title").agg(F.count(F.lit(1)).alias("free"), F.min("section").alias("section"))
    open_units = u.join(explicit.select("grp", "unit"), ["grp", "unit"], "left_anti")
    first = F.row_number().over(Window.partitionBy("grp", "title").orderBy("ord", "unit")) == 1
    by_title = open_units.withColumn("_first", first).join(free, ["grp", "title"], "left")
    method = F.when(F.col("free") > 1, "ambiguous").when((F.col("free") == 1) & F.col("_first"), "exact_normalized_title").otherwise("no_section")
    by_title = by_title.withColumn("method", method).select("grp", "unit", F.when(F.col("method") == "exact_normalized_title", F.col("section")).alias("section"), "method", F.when(F.col("method") == "exact_normalized_title", 0.96).alias("confidence"))
    return explicit.unionByName(lost).unionByName(by_title)


def similarity_summary(pairs: DataFrame, score: str, bands: dict[str, float]) -> DataFrame:
    """(measure, value): least, most and mean score in ten-thousandths, and how many pairs lie in each band (names by their lower bounds, highest first; below all: low)."""
    tenth = lambda c: F.floor(c * 10000 + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    s = F.col(score).cast("decimal(18,4)")
    band = F.lit("low")
    for name, bound in sorted(bands.items(), key=lambda b: b[1]):
        band = F.when(F.col(score) >= bound, name).otherwise(band)
    one = pairs.select(s.alias("s"), band.alias("band")).agg(F.count(F.lit(1)).alias("pairs"), tenth(F.min("s")).alias("least"), tenth(F.max("s")).alias("most"), tenth(F.avg("s")).alias("mean"), *[F.count_if(F.col("band") == b).alias(b) for b in [*bands, "low"]])
    return one.unpivot([], [c for c in one.columns], "measure", "value")


def coverage_counters(accepted: DataFrame, units: DataFrame) -> DataFrame:
    """(kind, key, n): accepted codes by domain and by skill, codes accepted more than once, units without any.

    accepted(unit, code, domain, skills), units(unit)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("未知"))
    one = accepted.dropDuplicates(["unit", "code"])
    domains = one.groupBy(F.lit("domain").alias("kind"), text("domain").alias("key")).agg(F.count_distinct("code").alias("n"))
    skills = one.select("code", F.explode("skills").alias("skill")).groupBy(F.lit("skill").alias("kind"), text("skill").alias("key")).agg(F.count_distinct("code").alias("n"))
    twice = one.groupBy(F.lit("duplicate").alias("kind"), text("code").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    left = units.select("unit").distinct().join(accepted.select("unit"), "unit", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unmatched_units").alias("kind"), F.lit("all").alias("key"), "n")
    return domains.unionByName(skills).unionByName(twice).unionByName(left)
