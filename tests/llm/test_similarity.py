"""Operators 1 to 3 against brute force on small fixtures."""

import itertools
import random
import re

import numpy as np
import pandas as pd
from hypothesis import given
from hypothesis import strategies as st

from tessella.llm import decontaminate, hamming, media, ngram_join

DOCS = "doc_id long, text string, item_id string, rep string, label int"


def documents(spark, texts):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 3) for i, t in texts], DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@given(st.lists(st.integers(0, 4), min_size=1, max_size=14), st.lists(st.integers(0, 4), max_size=20))
def test_lcs_is_the_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert decontaminate.lcs(a, b) == best[-1][-1]


def test_decontamination_finds_exact_and_paraphrased_items_only(spark):
    rng = random.Random(1)
    items = [(k, prose(rng, n, 5000)) for k, n in enumerate((20, 40, 100, 200))]
    texts = []
    for k, item in items:
        words = item.split()
        less = [w for w in words if rng.random() > 0.1]  # a tenth of the words is gone
        texts.append((10 * k, f"{prose(rng, 300)} {item} {prose(rng, 200)}"))
        texts.append((10 * k + 1, f"{prose(rng, 30)} {' '.join(less)} {prose(rng, 500)}"))
        texts.append((10 * k + 2, prose(rng, 3000)))
        texts.append((10 * k + 3, " ".join(words[: len(words) // 3])))  # too little of the item
    texts += [(900, None), (901, ""), (902, " \n"), (0, texts[0][1])]
    bench = spark.createDataFrame([(k, t, 0) for k, t in items] + [(77, None, 0), (78, "", 0), (None, "a b c", 0), (79, items[0][1], 0)], "item_id long, text string, doc_id int")
    got = decontaminate.decontaminate(documents(spark, texts), bench).collect()
    want = {(10 * k + j, k) for k, _ in items for j in (0, 1)} | {(0, 79), (1, 79)}
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert sum(r.doc_id == 0 and r.item_id == 0 for r in got) == 2  # the repeated row
    clean = decontaminate.clean_documents(documents(spark, texts), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in texts} - {i for i, _ in want} and clean.columns == documents(spark, []).columns
    rows = documents(spark, [(None, texts[0][1]), (None, "clean"), (2, texts[0][1]), (2, "clean too")])
    assert {r.text for r in decontaminate.clean_documents(rows, bench, items_per_block=2).collect()} == {"clean", "clean too"}
    assert {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(rows, bench, items_per_block=2).collect()} == {(None, 0), (None, 79), (2, 0), (2, 79)}


def brute_leak(text, item, share=0.8, with_answer=0.6, answer_share=0.8):
    """Whether any window of up to one and a half times the item's length holds the item by the rule."""
    words = lambda t: re.findall(r"(?:[0-9a-z_]|[^\x00-\x7f])+", t.lower())
    h, w = words(text), words(item)
    at = min(decontaminate.answer_start(item), max(0, len(w) - 1))
    numbers = {x: k for k, x in enumerate({*h, *w})}
    h, w = [numbers[x] for x in h], [numbers[x] for x in w]
    size = len(w) + len(w) // 2
    for lo in range(0, max(1, len(h) - size + 1), 2):
        window = h[lo : lo + size]
        whole = decontaminate.lcs(w, window) / len(w)
        if whole >= share or (whole >= with_answer and decontaminate.lcs(w[at:], window) / len(w[at:]) >= answer_share):
            return True
    return False


def test_decontamination_recall_against_every_window(spark):
    """Items of 12 to 120 words of which 62 to 100 % are kept, with words put in between: nine in ten of what a search of every window finds."""
    rng = random.Random(3)
    items, texts = [], []
    for k in range(60):
        n = rng.choice([12, 15, 20, 40, 80, 120])
        question, answer = prose(rng, n - 5, 3000), prose(rng, 5, 3000)
        items.append((k, f"{question}? {answer}."))
        kept = [w for w in question.split() if rng.random() < rng.uniform(0.55, 1.0)]
        for _ in range(rng.randrange(0, len(kept) // 3 + 1)):
            kept.insert(rng.randrange(len(kept) + 1), f"w{rng.randrange(3000)}")
        texts.append((k, f"{prose(rng, rng.randrange(5, 200), 3000)} {' '.join(kept)} {answer} {prose(rng, rng.randrange(5, 200), 3000)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(documents(spark, texts), bench).collect()}
    want = {k for k in range(60) if brute_leak(texts[k][1], items[k][1])}
    assert len(want) >= 40 and len(want & {d for d, i in got if d == i}) >= 0.9 * len(want), (len(want), len(want & {d for d, i in got if d == i}))
    assert all(brute_leak(texts[d][1], items[i][1]) for d, i in got if d != i)


def test_the_latent_space_comes_from_all_items_and_from_no_sample(spark):
    """Other ids of the same texts, of which a sample was chosen by id, change no cosine."""
    rng = random.Random(8)
    items = [(k, f"{prose(rng, 30, 900)}. {prose(rng, 5, 900)}.") for k in range(40)]
    texts = [prose(rng, 40, 900) + (" " + items[k][1] if k < 40 else "") for k in range(1500)]
    texts = [" ".join(w for j, w in enumerate(t.split()) if j % 9) for t in texts]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, two = ({(r.doc_id - low, r.item_id): r.cosine for r in decontaminate.decontaminate(documents(spark, [(low + k, t) for k, t in enumerate(texts)]), bench).collect()} for low in (0, 10**6))
    assert len(one) >= 36 and one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-5


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(documents(spark, []), none).count() == 0
    assert decontaminate.decontaminate(documents(spark, [(1, "a b c d")]), none).count() == 0


def brute_join(texts, n=5):
    sets = {}
    for i, t in texts:
        w = re.findall(r"(?:[0-9a-z_]|[^\x00-\x7f])+", (t or "").lower())
        sets.setdefault(i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else None)
    reps: dict = {}
    for i in sorted(sets):
        if sets[i] is not None:
            reps.setdefault(sets[i], i)
    label, links = {i: i for i in sets}, dict.fromkeys(sets, 0)
    for x, y in itertools.combinations(reps, 2):
        if 5 * len(x & y) >= 4 * len(x | y):
            a, b = reps[x], reps[y]
            links[a] += 1
            links[b] += 1
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return {i: (reps.get(s, i), label[reps.get(s, i)], links[reps.get(s, i)] if s else 0) for i, s in sets.items()}


def near_copies(rng, base, n):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(9)}"
        out.append(" ".join(words))
    return out


def test_ngram_join_equals_brute_force_with_hot_groups(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(30, 200)) for _ in range(60)]
    texts += near_copies(rng, texts[0], 3) + near_copies(rng, prose(rng, 150), 60) + [texts[5]] * 40
    texts += ["only four words here", "Only FOUR words, here", "", None, "...", "x", "ünïcödé wörter sind auch wörter " * 6]
    texts = list(enumerate(texts))
    for options in ({}, {"cold": 4, "block_rows": 7}):
        got = {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(documents(spark, texts), **options).collect()}
        assert got == brute_join(texts)
    kept = ngram_join.keep_one(documents(spark, texts))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c, _) in brute_join(texts).items() if i == c}


def test_ngram_join_tells_rows_apart(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (None, a), (None, "x y z"), (None, "x y z"), (None, None), (9, ""), (9, "")], "doc_id long, text string").selectExpr("*", "1 as row", "2 as row_number", "3 as id", "'s' as set_hash")
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = sorted(((r.doc_id, r.rep_id, r.class_id, r.n_copies) for r in ngram_join.ngram_join(rows).collect()), key=key)
    assert got == [(None, None, None, 1), (None, None, None, 2), (None, None, None, 2), (None, 1, 1, 3), (1, 1, 1, 3), (5, 1, 1, 3), (5, 5, 5, 2), (7, 5, 5, 2), (9, 9, 9, 1), (9, 9, 9, 1)]
    kept = ngram_join.keep_one(rows)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (5, b), (None, "x y z"), (None, None), (9, ""), (9, "")], key=repr) and kept.columns == rows.columns


def test_ngram_join_of_an_empty_table(spark):
    assert ngram_join.ngram_join(documents(spark, [])).count() == 0


def test_bands_meet_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.999)
    assert (bands, rows) == (18, 5)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def pgm(x):
    y = np.clip(np.rint(x), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (y.shape[1], y.shape[0]) + y.tobytes()


def scene(seed):
    r = np.random.default_rng(seed)
    x = np.full((120, 120), 128.0)
    for _ in range(60):
        y0, x0, h, w = r.integers(0, 110), r.integers(0, 110), r.integers(5, 25), r.integers(5, 25)
        x[y0 : y0 + h, x0 : x0 + w] = r.integers(0, 255)
    return x


def test_media_links_crops_and_edits_only(spark):
    a, b = scene(1), scene(2)
    images = [(0, pgm(a)), (1, pgm(a)), (2, pgm(a[10:110, 8:118])), (3, pgm(a * 0.8 + 20)), (4, pgm(b)), (5, pgm(scene(3))), (6, None), (7, b"junk"), (8, b""), (9, pgm(np.zeros((40, 40)))), (10, pgm(np.zeros((40, 40))))]
    rows = spark.createDataFrame([(i, bytearray(x) if x is not None else None, "k") for i, x in images], "media_id long, image binary, key string")
    got = {r.media_id: r for r in media.media_copies(rows, "media_id", "image").collect()}
    assert len(got) == len(images)
    assert {i: r.class_id for i, r in got.items()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9}
    assert got[1].rep_id == 0 and got[0].n_copies == 2
    assert media.media_copies(rows.limit(0), "media_id", "image").count() == 0


def turned(x, degrees):
    t = np.deg2rad(degrees)
    h, w = x.shape
    yy, xx = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    return media.between(x, np.clip(np.cos(t) * yy - np.sin(t) * xx + (h - 1) / 2, 0, h - 1.01), np.clip(np.sin(t) * yy + np.cos(t) * xx + (w - 1) / 2, 0, w - 1.01))


def edits(x, rng):
    n = len(x)
    return [x[n // 8 :, n // 10 :], media.resize(x, 0.8), media.resize(x, 1.3), np.rot90(x), turned(x, 17), x * 0.7 + 30, x + rng.normal(0, 6, x.shape)]


def test_media_classes_against_comparing_all_pairs(spark):
    """At least nine in ten links of all-pairs comparison hold in the classes, and no class joins what they don't."""
    rng = np.random.default_rng(8)
    images = [pgm(y) for k in range(12) for y in (scene(k), *edits(scene(k), rng))] + [pgm(scene(100 + k)) for k in range(30)]
    images += images[:3]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(images)], "media_id long, image binary")
    got = {r.media_id: r.class_id for r in media.media_copies(rows, "media_id", "image").collect()}
    points = [media.describe(media.decode(x), 24) for x in images]
    links = [(i, j) for i, j in itertools.combinations(range(len(images)), 2) if media.alike(points[i], points[j], 40, 5)]
    label = list(range(len(images)))
    for i, j in links:
        low, high = sorted((label[i], label[j]))
        label = [low if v == high else v for v in label]
    assert len(links) > 200 and np.mean([got[i] == got[j] for i, j in links]) >= 0.9
    assert all(label[i] == label[j] for i, j in itertools.combinations(range(len(images)), 2) if got[i] == got[j])


def test_media_loses_no_link(spark, monkeypatch):
    """Classes are those of comparing all pairs, in one block or many; the tables and the sketch alone miss links of turned and enlarged images."""
    rng = np.random.default_rng(8)
    scenes = [scene(k) for k in range(12)]
    images = [pgm(y) for x in scenes for y in (x, *edits(x, rng), media.resize(x, 1.5), turned(x, 31), turned(media.resize(x, 1.2), 9))]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(images)], "media_id long, image binary")
    points = [media.describe(media.decode(x), 24) for x in images]
    label = list(range(len(images)))
    for i, j in itertools.combinations(range(len(images)), 2):
        if media.alike(points[i], points[j], 40, 5):
            low, high = sorted((label[i], label[j]))
            label = [low if v == high else v for v in label]
    for block in (6144, 9):
        monkeypatch.setattr(media, "WAVE", 5)
        got = {r.media_id: r.class_id for r in media.media_copies(rows, "media_id", "image", block=block).collect()}
        assert [got[i] for i in range(len(images))] == label


def test_near_rows_equal_comparing_all():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    rows = lambda n: base[rng.integers(0, 40, n)] ^ np.packbits(rng.random((n, 256)) < rng.choice([0.02, 0.1, 0.2], (n, 1)), axis=1)
    a, b = rows(700), rows(1203)
    far = np.bitwise_count(a[:, None] ^ b[None]).sum(2, dtype=int)
    for distance in (0, 40, 70):
        got = hamming.Index(b, distance).pairs(a, lambda i, j: i != j, 10**9)
        assert sorted(zip(*(x.tolist() for x in got))) == [(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(far <= distance))) if i != j]
    assert hamming.Index(b, 70).pairs(a, lambda i, j: i != j, 10) is None


def test_a_band_with_many_near_points_is_halved(monkeypatch):
    images = [media.describe(scene(k % 3) + k, 24) for k in range(12)]
    pdf = pd.DataFrame({"rep": range(12), "label": range(12), "right": False, "points": [x.tobytes() for x in images]})
    want = media.block_links(40, 5)((0, 0, 0), pdf).to_numpy().tolist()
    monkeypatch.setattr(media, "NEAR", 3)
    assert media.block_links(40, 5)((0, 0, 0), pdf).to_numpy().tolist() == want and len(want) == 9


def test_media_rows_do_not_depend_on_how_full_a_list_is(spark):
    a, b, rng = scene(4), scene(5), np.random.default_rng(5)
    images = []
    for k in range(24):
        y, x = rng.integers(0, 12, 2)
        images.append((k, bytearray(pgm((a, b)[k % 2][y : y + 105, x : x + 105] * rng.uniform(0.7, 1.0) + rng.normal(0, 2, (105, 105)) + 10))))
    rows = spark.createDataFrame([*images, (None, images[1][1]), (None, None), (3, images[3][1])], "media_id long, image binary")
    few, many = (sorted(map(repr, media.media_copies(rows, "media_id", "image", **o).collect())) for o in ({"cold": 2, "block": 5}, {"cold": 10**6}))
    assert few == many and len({r for r in few}) >= 26
    got = [r.class_id for r in media.media_copies(rows, "media_id", "image", cold=2, block=5).where("media_id is not null").collect()]
    assert set(got) == {0, 1}


def test_overfull_lists_are_compared_in_blocks():
    scenes = [media.describe(scene(k), 24) for k in (1, 2)] + [media.describe(media.resize(scene(1), 0.8), 24)]
    pdf = pd.DataFrame({"rep": [7, 8, 9], "label": [7, 8, 9], "right": [False, False, True], "points": [x.tobytes() for x in scenes]})
    assert media.block_links(40, 5)((0, 0, 1), pdf).to_numpy().tolist() == [[7, 9]]
    assert media.block_links(40, 5)((0, 0, 1), pdf.assign(label=[7, 8, 7])).empty


def test_images_that_cannot_be_read():
    import struct
    import zlib

    bomb = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBBI", 13, b"IHDR", 1 << 20, 1 << 20, 8, 0, 0, 0, 0, 0)
    data = zlib.compress(b"\0" + bytes(3))
    short = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBBI", 13, b"IHDR", 9, 9, 8, 0, 0, 0, 0, 0) + struct.pack(">I4s", len(data), b"IDAT") + data + bytes(4)
    for raw in (None, b"", b"P5", b"P5 9999999999 9999999999 255\n", b"P5 2 2 255\nab", b"\xff\xd8\xff\xe0jpeg", bomb, short):
        assert media.decode(raw) is None
