"""Operator 9, secret scans by multipart credential linking, in DataFrame functions only.

Base spans (assign, access, hex) are found in every whole text. Parts too weak to report alone
(short or unnamed secrets, user names and addresses, endpoints) become intervals, which an interval
join (equal buckets of the text, then distance) sets against each other; a weak part is reported only
where its complement stands within `reach` characters. Positions count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# The method's own: weak parts. Repeated groups are possessive: Java's matcher recurses on others, and a long text ends the process.
WEAK = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"
IDENT = r"""(?i)(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"""
ENDPOINT = r"""(?:https?|ftp|postgresql|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"""
KINDS = ["assign", "access", "hex", "weak", "ident", "endpoint"]
STRONG = 12
SHORT = 6
WEAK_NO = KINDS.index("weak")


def lengths(text: Column, pattern: str, kind: str, value: int | None = None) -> Column:
    """The leftmost matches in order, as array<struct<kind_no, nth, gap, hit, size>>: characters before
    the match since the last one, of the match, and of it or its group `value`. Texts between matches
    and matches alternate, so running sums give the positions."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value is not None else found
    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), sizes.alias("value"))
    out = F.transform(rows, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind_no"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["value"]).alias("size")))
    return F.when(text.rlike(pattern), out).otherwise(F.expr("cast(array() as array<struct<kind_no:int,nth:int,gap:int,hit:int,size:int>>)"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: row_key, doc_id and the columns in keep, as kept_<name>, one per row of docs.
    spans: row_key, kind_no, start, end, linked; base spans (linked false) and the weak ones that are linked.

    The scope of a part is what stands within `reach` characters of it in the same text. Null and empty
    texts have no spans. Repeated rows are scanned each on its own; columns of docs that aren't in keep
    are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("the_text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    text = F.col("the_text")
    found = F.concat(lengths(text, ASSIGN, "assign", 2), *[lengths(text, p, k) for p, k in ((ACCESS, "access"), (HEX, "hex"), (WEAK, "weak"), (IDENT, "ident"), (ENDPOINT, "endpoint"))])
    # Written once: the row keys hold for all that follows, and no text is scanned twice.
    parts = materialize(parts.select("row_key", "doc_id", *[f"kept_{c}" for c in keep], found.alias("found")), "secret-parts")
    order = Window.partitionBy("row_key", "kind_no").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.where(F.size("found") > 0).select("row_key", F.explode("found").alias("f")).select("row_key", "f.*").withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(order))
    assign = F.col("kind_no") == KINDS.index("assign")
    # A short assignment is a weak part.
    rows = rows.where(~assign | (F.col("size") >= SHORT)).select("row_key", F.when(assign & (F.col("size") < STRONG), WEAK_NO).otherwise(F.col("kind_no")).alias("kind_no"), (F.col("end") - F.col("hit")).alias("start"), "end")
    rows = materialize(rows, "secret-spans")
    # role: s secrets, i identifiers (an access key is one), e endpoints.
    roles = rows.withColumn("role", F.element_at(F.array(*[F.lit(x) for x in ("s", "i", "s", "s", "i", "e")]), F.col("kind_no") + 1))
    bucket = lambda c: F.floor(F.col(c) / reach)
    left = roles.where(F.col("kind_no") >= WEAK_NO).select("row_key", "kind_no", "start", "end", "role", F.explode(F.sequence(bucket("start") - 1, bucket("end") + 1)).alias("bucket"))
    right = roles.select("row_key", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("role").alias("r2"), F.explode(F.sequence(bucket("start"), bucket("end"))).alias("bucket")).distinct()
    near = left.join(right, ["row_key", "bucket"]).where((F.col("s2") <= F.col("end") + reach) & (F.col("e2") >= F.col("start") - reach) & (F.col("role") != F.col("r2")))
    has = lambda r: F.max(F.col("r2") == r)
    seen = near.groupBy("row_key", "kind_no", "start", "end").agg(has("s").alias("s"), has("i").alias("i"), has("e").alias("e"))
    names = {k: KINDS.index(k) for k in ("weak", "ident", "endpoint")}
    linked = seen.where((F.col("kind_no") == names["weak"]) & F.col("i") | (F.col("kind_no") == names["ident"]) & F.col("s") | (F.col("kind_no") == names["endpoint"]) & F.col("s") & F.col("i"))
    base = rows.where(F.col("kind_no") < WEAK_NO).withColumn("linked", F.lit(False))
    return parts.drop("found"), base.unionByName(linked.select("row_key", "kind_no", "start", "end", F.lit(True).alias("linked")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Null and empty texts, and texts without spans, have counts of 0, the SHA-256 of an empty text and
    empty spans. A null id stays null; repeated rows give a row each; an empty table gives no rows.
    """
    rows, spans = scan(docs, id_col, text_col)
    span = F.struct("start", "kind_no", "end")
    count = lambda k: F.sum((F.col("kind_no") == KINDS.index(k)).cast("long")).alias(f"n_{k}")
    found = spans.groupBy("row_key").agg(count("assign"), count("access"), count("hex"), F.collect_list(F.when(~F.col("linked"), span)).alias("base"), F.collect_list(span).alias("all"), F.sum(F.col("linked").cast("long")).alias("n_linked"))
    found = found.select("row_key", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_linked")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(found, "row_key", "left").select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every secret (base and weak spans) replaced by <kind>; identifiers and endpoints stay.

    Overlapping spans are one, named after the first. Columns and row count as given; texts without
    secrets, null ones too, are left as they are.
    """
    rows, spans = scan(docs, id_col, text_col, keep=tuple(docs.columns))
    order = Window.partitionBy("row_key").orderBy("start", "kind_no", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    secret = spans.where(F.col("kind_no") <= WEAK_NO).withColumn("new", F.when(F.col("start") < before, 0).otherwise(1))
    merged = secret.withColumn("no", F.sum("new").over(order)).groupBy("row_key", "no").agg(F.min(F.struct("start", "kind_no")).alias("first"), F.max("end").alias("end"))
    merged = merged.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("first.start", "end", "first.kind_no"))).alias("cuts"))
    names, text, cuts = F.array(*[F.lit(f"<{k}>") for k in KINDS]), F.col(f"kept_{text_col}"), F.col("cuts")
    last = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at(cuts, F.greatest(i, F.lit(1)))["end"])
    kept = F.transform(cuts, lambda s, i: F.concat(F.substr(text, last(i) + 1, s["start"] - last(i)), F.element_at(names, s["kind_no"] + 1)))
    clean = F.concat(F.array_join(kept, ""), F.substr(text, F.element_at(cuts, -1)["end"] + 1))
    changed = rows.join(merged, "row_key", "left").withColumn("clean_text", F.when(cuts.isNotNull(), clean).otherwise(text))
    return changed.select(*[F.col("clean_text" if c == text_col else f"kept_{c}").alias(c) for c in docs.columns])


__all__ = ["redact", "report", "scan"]
