"""Operator 2, n-gram Jaccard join: MinHash banding, a shuffle on band hashes, then verification on full n-gram sets.

1. One pass over the texts gives each document the hash of its n-gram set, the set's size and its
   band hashes. Documents of the same set are copies: one representative each goes on.
2. Representatives that share a band hash form a bucket. Buckets of at most `cold` members yield
   their pairs, each once; those whose minhash sketches agree enough are verified on the full sets.
3. Members of larger buckets are joined into hot components. Each member's exact distance to the
   component's first member (the pivot) places it in a shell a tenth of the limit wide. The Jaccard
   distance is a metric, so shells near the pivot link without a comparison and far-apart shells
   cannot link; only what is left is compared, block against block, spread over tasks.
4. Links join into classes. No step lists the pairs of a large group, and none leaves one out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import BASE, U, Words, bounded, lowered, mix, shingles, slices
from .runtime import discard, materialize, ship

SHELLS = 10  # shells within the limit of distance


def choose_bands(threshold: float, recall: float, hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold shares a band with probability `recall`, and the rows are
    as many as `hashes` minhashes allow, since longer bands bring fewer unlike pairs together."""
    found = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows) for rows in range(1, hashes + 1)]
    return max((x for x in found if x[0] * x[1] <= hashes), key=lambda x: x[1], default=found[0])


def band_hashes(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents x bands, documents x sketch words of 16 minhashes, 4 bits each); rows of documents without n-grams are 0."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, bands), dtype=np.int64)
    sketch = np.zeros((len(bounds) - 1, -(-bands * rows // 16)), dtype=np.int64)
    if not len(some):
        return out, sketch
    bits = np.zeros((len(some), sketch.shape[1]), dtype=U)
    at = bounds[:-1][some]
    make = np.random.default_rng(20240229)
    a = make.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * U(2) + U(1)
    b = make.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    for j in range(bands):
        acc = np.full(len(some), j + 1, dtype=U)
        for i in range(j * rows, (j + 1) * rows):
            least = np.minimum.reduceat((grams * a[i] + b[i]) >> U(32), at)
            acc = acc * U(BASE) + least
            bits[:, i // 16] |= (mix(least) & U(15)) << U(4 * (i % 16))
        out[some, j] = mix(acc).view(np.int64)
    sketch[some] = bits.view(np.int64)
    return out, sketch


def agreement(x, y, words: int, hashes: int):
    """Share of the minhashes of two sketches whose 4 bits agree."""
    odd = F.lit(0)
    for i in range(words):
        z = x[i].bitwiseXOR(y[i])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111))
        odd = odd + F.bit_count(z)
    return 1 - odd / hashes


def set_name(own: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """docs(row, id, text) -> (row, id, set_hash, n_grams, bands, sketch): set_hash is null where a text has no word."""

    def run(it):
        for batch in bounded(it, 2):
            text = lowered(batch.column(2))
            for lo, hi, data, offs in slices(text):
                grams, bounds = shingles(Words(data, offs), n)
                marks, sketch = band_hashes(grams, bounds, bands, rows)
                own = [np.unique(grams[bounds[d] : bounds[d + 1]]) for d in range(hi - lo)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), pa.int64())) for x in (marks, sketch)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(map(set_name, own), pa.string()), pa.array(map(len, own), pa.int32()), *lists], ["row", "id", "set_hash", "n_grams", "bands", "sketch"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, "row long, id long, set_hash string, n_grams int, bands array<long>, sketch array<long>")


BITS = 1 << 27  # of the filter on ids: 16 MB at most, whatever is asked for
PAGE = 1 << 15


def id_filter(ids: DataFrame, col: str) -> dict[int, bytes]:
    """Bits of ids modulo BITS, in pages. It lets all of ids through and, while they fill few of the bits, little else."""
    at = F.pmod(F.col(col), F.lit(BITS))
    pages = ids.select(F.floor(at / PAGE).cast("int").alias("page"), F.pmod(at, F.lit(PAGE)).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return {r.page: bytes(r.bits) for r in pages.collect()}


def all_bits(pages: dict[int, bytes]) -> np.ndarray:
    """The filter as BITS / 8 bytes."""
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for page, bits in pages.items():
        out[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(bits, dtype=np.uint8)[: PAGE // 8]
    return out


def passes(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = ids % BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def gram_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """docs(id, text), wanted(rep, set_hash, id) -> (rep, grams): the sorted distinct n-gram hashes, 8 bytes each, of the wanted sets.

    A filter of fixed size on the ids (null ids pass) keeps most other texts out of the shuffle; the
    join on the set then is exact, whatever ids a text has.
    """
    pages = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.where("id is not null"), "id"))

    def run(it):
        bits = all_bits(pages.value)
        for batch in bounded(it, 1):
            ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pa.array(np.flatnonzero(passes(ids, bits) | batch.column(0).is_null().to_numpy(zero_copy_only=False)))
            for lo, hi, data, offs in slices(lowered(batch.column(1).take(at))):
                grams, bounds = shingles(Words(data, offs), n)
                sets = [np.unique(grams[bounds[d] : bounds[d + 1]]) for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_name, sets), pa.string()), pa.array([x.tobytes() for x in sets], pa.binary())], ["set_hash", "grams"])

    sets = docs.select("id", "text").mapInArrow(run, "set_hash string, grams binary")
    return sets.join(wanted.select("rep", "set_hash"), "set_hash").select("rep", "grams").dropDuplicates(["rep"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) -> (a, b, inter, both): sizes of the intersection and the union of their full sets."""

    def run(it):
        for batch in it:
            inter, both = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                inter.append(len(np.intersect1d(x, y, assume_unique=True)))
                both.append(len(x) + len(y) - inter[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(both, pa.int64())], ["a", "b", "inter", "both"])

    joined = pairs.join(sets.select(F.col("rep").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("grams").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, inter long, both long")


def linked(num: int, den: int):
    return F.col("inter") * den >= F.col("both") * num


def block_links(num: int, den: int):
    """Compares two blocks (or one with itself): (a, b, n), where n counts the links of a and rows with b join a to b."""

    def matrix(rows, index, columns):
        out = np.zeros((len(rows), columns), dtype=np.float32)
        for i, row in enumerate(rows):
            out[i, row[(row >= index) & (row < index + columns)] - index] = 1
        return out

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "rep"])
        sets = [np.frombuffer(x, dtype=U) for x in pdf.grams]
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        rows = np.split(flat, np.cumsum([len(x) for x in sets])[:-1])
        left = int((pdf.side == 0).sum())
        same = left == len(pdf)
        a, b = rows[:left], rows if same else rows[left:]
        inter = np.zeros((len(a), len(b)), dtype=np.float32)
        for at in range(0, int(flat.max()) + 1, 4096):
            x = matrix(a, at, 4096)
            inter += x @ (x if same else matrix(b, at, 4096)).T
        sizes = np.array([len(x) for x in rows], dtype=np.int64)
        inter = np.rint(inter).astype(np.int64)
        both = sizes[:left, None] + (sizes if same else sizes[left:])[None] - inter
        link = inter * den >= both * num
        if same:
            np.fill_diagonal(link, False)
        ids = pdf.rep.to_numpy()
        own, other = ids[:left], ids if same else ids[left:]
        out = [pd.DataFrame({"a": own, "b": -1, "n": link.sum(1)})]
        if not same:
            out.append(pd.DataFrame({"a": other, "b": -1, "n": link.sum(0)}))
        # A spanning forest of the links is enough for the classes.
        parent = {int(x): int(x) for x in ids}

        def top(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges = []
        for i in range(left):
            for j in np.flatnonzero(link[i]):
                x, y = top(int(own[i])), top(int(other[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((int(own[i]), int(other[j]), 0))
        out.append(pd.DataFrame(edges, columns=["a", "b", "n"], dtype="int64"))
        return pd.concat(out, ignore_index=True).astype("int64")

    return run


def hot_links(hot: DataFrame, sets: DataFrame, num: int, den: int, block_rows: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """hot(rep, comp) -> edges(a, b) that join the linked members, and (rep, n_links) within components."""
    pivot = overlaps(hot.select(F.col("rep").alias("a"), F.col("comp").alias("b")), sets)
    shells = materialize(
        pivot.select(F.col("a").alias("rep"), F.col("b").alias("comp"), "inter", "both", F.floor((F.col("both") - F.col("inter")) * (SHELLS * den) / (F.col("both") * (den - num))).cast("int").alias("shell")).join(sets.select("rep", F.length("grams").alias("size")), "rep"), "hot-shells")
    stats = materialize(shells.groupBy("comp", "shell").agg(F.count("*").alias("count"), F.ceil(F.greatest(F.count("*") / block_rows, F.sum("size") / block_bytes)).cast("int").alias("nb")), "hot-stats")
    # Links that the triangle inequality makes certain: both shells together stay within the limit.
    other = stats.select("comp", F.col("shell").alias("t"), F.col("count").alias("there"))
    sure = stats.join(other, "comp").where(F.col("shell") + F.col("t") + 2 <= SHELLS).groupBy("comp", "shell").agg(F.sum("there").alias("sure"))
    certain = shells.join(sure, ["comp", "shell"]).select("rep", (F.col("sure") - F.when(F.col("shell") * 2 + 2 <= SHELLS, 1).otherwise(0)).alias("n"))
    edges = shells.where(linked(num, den) & (F.col("rep") != F.col("comp"))).select(F.col("rep").alias("a"), F.col("comp").alias("b"))
    # The rest, block against block.
    placed = shells.join(stats.select("comp", "shell", "nb"), ["comp", "shell"]).select("comp", "shell", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int").alias("block"), "rep")
    left = stats.select("comp", "shell", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"))
    right = left.select("comp", F.col("shell").alias("t"), F.col("block").alias("tb"))
    todo = materialize(left.join(right, "comp").where(((F.col("shell") < F.col("t")) | ((F.col("shell") == F.col("t")) & (F.col("block") <= F.col("tb")))) & (F.col("shell") + F.col("t") + 2 > SHELLS) & (F.col("t") - F.col("shell") - 1 < SHELLS)), "hot-todo")
    keys = ["comp", "shell", "block", "t", "tb"]
    ours = placed.join(todo, ["comp", "shell", "block"]).select(*keys, F.lit(0).alias("side"), "rep")
    theirs = placed.select("comp", F.col("shell").alias("t"), F.col("block").alias("tb"), "rep").join(todo.where((F.col("shell") != F.col("t")) | (F.col("block") != F.col("tb"))), ["comp", "t", "tb"]).select(*keys, F.lit(1).alias("side"), "rep")
    found = materialize(ours.unionByName(theirs).join(sets, "rep").groupBy(*keys).applyInPandas(block_links(num, den), "a long, b long, n long"), "hot-links")
    edges = edges.unionByName(found.where("b >= 0").select("a", "b"))
    counts = certain.unionByName(found.where("b < 0").select(F.col("a").alias("rep"), "n")).groupBy("rep").agg(F.sum("n").alias("n"))
    return edges, counts


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5, recall: float = 0.999, cold: int = 16, block_rows: int = 384, block_bytes: int = 4 << 20, row_col: str | None = None) -> DataFrame:
    """Documents whose word n-gram sets have a Jaccard similarity of num/den or more.

    Returns one row per row of docs: doc_id, rep_id (smallest id with the same n-gram set), class_id
    (smallest id of the class that links join it to), n_copies (rows with this set, itself included),
    n_links (other sets that its set links to), n_grams; and with row_col (a unique long, stable over
    runs of docs) that number and class_row, the row that stands for the class: the first by id (null
    last) and number.

    Rows are told apart by a number of their own, so an id may stand for several texts, or be null: a
    null id takes part as any other and is a rep_id or class_id only where no copy has an id. Texts of
    fewer than n words have one n-gram, all their words. Null texts and texts without a word link to
    nothing: their class is their own id, with 1 copy and 0 links. Ids are integers; further columns
    are ignored, whatever their names; repeated rows count as copies; an empty table gives no rows. A
    pair at the threshold is found with probability `recall` or more.
    """
    bands, rows = choose_bands(num / den, recall)
    base = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = materialize(signatures(base, n, bands, rows), "signatures")
    # A set is known by the row of its first document: by id, null last, then by row.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "bands", "sketch"))
    reps = materialize(marked.where("set_hash is not null").groupBy("set_hash").agg(first.alias("first"), F.count("*").alias("n_copies")).select("set_hash", F.col("first.row").alias("rep"), "first.id", "first.bands", "first.sketch", "n_copies"), "reps")
    members = reps.select("rep", F.posexplode("bands").alias("band", "mark"))
    buckets = materialize(members.groupBy("band", "mark").agg(F.count("*").alias("size"), F.min("rep").alias("first")).where("size > 1"), "buckets")
    filled = members.join(buckets, ["band", "mark"])
    lists = filled.where(F.col("size") <= cold).groupBy("band", "mark").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    pairs = lists.select(F.posexplode("reps").alias("at", "a"), "reps").select("a", F.explode(F.slice("reps", F.col("at") + 2, F.lit(cold))).alias("b")).distinct()
    hot_rows = filled.where(F.col("size") > cold)
    any_hot = not buckets.where(F.col("size") > cold).isEmpty()
    if any_hot:
        hot = materialize(components(hot_rows.select(F.col("rep").alias("a"), F.col("first").alias("b"))).select(F.col("id").alias("rep"), F.col("label").alias("comp")), "hot")
        pairs = pairs.join(hot.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a", "left").join(hot.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b")
    # A pair at the threshold agrees in about (1 + 15 num / den) / 16 of its sketch. Seven standard
    # deviations below that, full sets need not be fetched: such a pair is missed once in 10 ** 11.
    share = (1 + 15 * num / den) / 16
    least = share - 7 * math.sqrt(share * (1 - share) / (bands * rows))
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(agreement(F.col("sa"), F.col("sb"), -(-bands * rows // 16), bands * rows) >= least)
    pairs = materialize(likely.select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    if any_hot:
        wanted = wanted.unionByName(hot.select("rep"))
    wanted = reps.select("rep", "set_hash", "id").join(wanted.distinct(), "rep", "left_semi")
    sets = materialize(gram_sets(base, wanted, n), "sets")
    links = materialize(overlaps(pairs, sets).where(linked(num, den)).select("a", "b"), "links")
    edges, counts = links, links.select(F.col("a").alias("rep"), F.lit(1).cast("long").alias("n")).unionByName(links.select(F.col("b").alias("rep"), F.lit(1).cast("long").alias("n")))
    if any_hot:
        more, within = hot_links(hot, sets, num, den, block_rows, block_bytes)
        edges, counts = edges.unionByName(more), counts.unionByName(within)
    classes = components(edges).withColumnRenamed("id", "rep").join(reps.select("rep", "id"), "rep")
    best = classes.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rep")).alias("best"))
    classes = materialize(classes.join(best, "label").select("rep", F.col("best.id").alias("class_id"), F.col("best.rep").alias("class_row"), F.lit(True).alias("classed")), "classes")
    discard(buckets, pairs, sets)
    counts = counts.groupBy("rep").agg(F.sum("n").alias("n_links"))
    known = reps.select("set_hash", "rep", F.col("id").alias("rep_id"), "n_copies").join(classes, "rep", "left").join(counts, "rep", "left")
    out = marked.select("row", "id", "set_hash", "n_grams").join(known, "set_hash", "left")
    alone = F.col("rep").isNull()
    shown = [F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("rep_id")).alias("rep_id"), F.when(alone, F.col("id")).when(F.col("classed"), F.col("class_id")).otherwise(F.col("rep_id")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_grams"]
    return out.select(*([F.col("row").alias(row_col), F.coalesce("class_row", "rep", "row").alias("class_row")] if row_col else []), *shown)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay when each class keeps the first by id (null ids last); columns as given.

    Of repeated rows one stays; null texts and texts without a word all stay. The rows are written
    once with a number, which tells them apart.
    """
    number = "row_number"
    while number in docs.columns:
        number += "_"
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    gone = ngram_join(numbered, row_col=number, **options).where(F.col(number) != F.col("class_row")).select(number)
    return numbered.join(gone, number, "left_anti").select(docs.columns)


__all__ = ["choose_bands", "keep_one", "ngram_join"]
