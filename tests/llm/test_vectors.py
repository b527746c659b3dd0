"""Operators 11 to 13 against SQL, plain loops and NumPy."""

import base64
import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from tessella import scratch
from tessella.llm import queries, vector_codes, warc, whitening

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["op11_warc", "op13_vector_codes"])
def test_query_equals_its_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, DIR)
    cur = sql.execute(queries.ORACLES[name])
    assert got.columns == [c[0] for c in cur.description]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


PAGES = [
    (1, "http://a/é\r\nx", "one\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5000000\r\n\r\nzzz"),
    (2, None, "WARC/1.WARC/1."),
    (3, "b", None),
    (None, "q", ""),
    (4, "q", ""),
    (4, "q", ""),
    (2, "b", "WARC/1.WARC/1."),
    (5, "v", "a\r\n\r\n" * 3000),
    (6, "v", "W" * 70000 + "WARC/1." * 3000),
    (8, "z", "same €"),
    (7, "z", "same €"),
    (9, "1", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\na\r\n\r\nWARC/1.0\r\nWARC-Type: revisit\r\nContent-Length: 99999999999999999999\r\n\r\n"),
    (10, "x", "same €" * 200000),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain(pages, least):
    """By a loop over pages in order of their ids, nulls last."""
    out, seen = [], {}
    for key, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        n, d = len((html or "").encode()), digest(html)
        if n >= least and d in seen:
            out.append((key, n, d, "revisit", seen[d]))
        else:
            seen[d] = key
            out.append((key, n, d, "response", None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,compression,most", [(0, "none", "2k"), (10, "none", "128m"), (0, "gzip", "2k"), (10**9, "none", "128m")])
def test_archives_are_an_exact_round_trip(spark, tmp_path, least, compression, most):
    pages = spark.createDataFrame([(*p, "n", 1) for p in PAGES], "page_id long, url string, html string, digest string, row int").coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    try:
        got = warc.round_trip(pages, least=least, path=f"{tmp_path}/a", compression=compression)
        assert sorted(map(tuple, got.collect()), key=repr) == plain(PAGES, least)
        records = warc.read_archives(spark, f"{tmp_path}/a").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r.whole for r in records) and len({r.record_id for r in records}) == len(PAGES)
    kept = [r for r in records if r.type == "response"]
    assert sorted(bytes(r.payload).decode() for r in kept) == sorted({h or "" for _, _, h in PAGES} if least == 0 else [h or "" for k, (_, _, h) in enumerate(PAGES) if len((h or "").encode()) < least or all((h or "") != (g or "") for _, _, g in PAGES[:k])])
    assert all(r.profile == warc.PROFILE and not r.payload and r.refers_to in {k.record_id for k in kept} for r in records if r.type == "revisit")
    assert {r.target_uri for r in records if r.page_key in ("1", "2")} == {"http://a/é x", "urn:page:2", "b"}


def test_archives_have_the_format_byte_by_byte(spark, tmp_path):
    """A plain reader that goes by the Content-Lengths alone finds the records, one behind the other."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/a", date="2020-01-02T03:04:05Z")
    found = []
    for f in (tmp_path / "a").glob("part-*"):
        raw, at = f.read_bytes(), 0
        while at < len(raw):
            head, blank, _ = raw[at:].partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            start = at + len(head) + 4
            at = start + int(fields["Content-Length"]) + 4
            assert first == "WARC/1.1" and blank and raw[at - 4 : at] == b"\r\n\r\n"
            http, _, body = raw[start : at - 4].partition(b"\r\n\r\n")
            assert f"Content-Length: {len(body)}".encode() in http or fields["WARC-Type"] == "revisit" and not body
            if body:
                assert fields["WARC-Payload-Digest"] == "sha1:" + digest(body.decode())
            found.append((fields.get("X-Page-Key"), fields["WARC-Type"], fields["WARC-Date"]))
    assert sorted(found, key=repr) == sorted(((str(k) if k is not None else None, t, "2020-01-02T03:04:05Z") for k, _, _, t, _ in plain(PAGES, 0)), key=repr)


def test_foreign_archives(spark, tmp_path):
    """Lower case names, version 1.0, records without HTTP headers, text before the first mark, a record cut short, a lost original."""
    warcs = tmp_path / "w"
    warcs.mkdir()
    rec = lambda *h, body="": "\r\n".join(["WARC/1.0", *h]) + "\r\n\r\n" + body + "\r\n\r\n"
    (warcs / "a.warc").write_text(
        "junk\n"
        + rec("warc-type: warcinfo", "content-length: 3", body="a=b")
        + rec("WARC-Type: resource", "Content-Length: 2", "WARC-Concurrent-To: <x>", "WARC-Concurrent-To: <y>", body="hi")
        + rec("WARC-Type: revisit", "WARC-Refers-To: <urn:gone>", "WARC-Payload-Digest: sha1:ABC", "Content-Length: 0")
        + "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:r>\r\nContent-Length: 50\r\n\r\nshort",
        newline="",
    )
    got = {r.type: (bytes(r.payload).decode(), r.whole, r.digest) for r in warc.read_archives(spark, str(warcs)).collect()}
    assert got == {"warcinfo": ("a=b", True, None), "resource": ("hi", True, None), "revisit": ("", True, "ABC"), "response": ("short", False, None)}
    assert {tuple(r) for r in warc.resolve(warc.read_archives(spark, str(warcs))).collect()} == {(None, 5, digest("short"), "response", None), (None, None, "ABC", "revisit", None)}


def test_no_page_no_archive(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).collect() == []


NAN, INF = float("nan"), float("inf")
ODD = [None, [], [1.0, 2.0], [NAN] * 8, [INF] * 8, [None] * 8, [-INF, *[0.0] * 7]]


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, label, "c") for k, v, label in rows], "vec_id long, embedding array<float>, label int, code string")


def made(seed, n, width=8, kinds=40):
    rng = np.random.default_rng(seed)
    pool = np.round(rng.normal(size=(kinds, width)) * np.arange(width, 0, -1), 3).astype(np.float32)
    return [(k, pool[rng.integers(kinds)].tolist(), int(rng.integers(3)) if k % 5 else None) for k in range(n)]


def test_whitening_equals_numpy_on_distinct_rows(spark):
    rows = made(1, 200)
    rows += [(None, rows[0][1], 1), (3, rows[3][1], 1)] + [(1000 + k, v, 1) for k, v in enumerate(ODD)]
    got = whitening.whitened(vectors(spark, rows)).collect()
    kept = [(k, np.floor(np.array(v, dtype=np.float64) * 256).astype(int)) for k, v, _ in rows if k is None or k < 1000]
    x = np.unique([v for _, v in kept], axis=0)
    n, s = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    total = np.trace(np.cov(x.T, bias=True))
    for c in range(4):
        mine = sorted(((r.vec_id is None, r.vec_id or 0, r.whitened, r.deviation) for r in got if r.component == c + 1))
        want = sorted((k is None, k or 0, float((v - s / n) @ axes[:, c] / math.sqrt(values[c])), int(((n * v - s) ** 2).sum())) for k, v in kept)
        sign = np.sign(mine[0][2] * next(w for w in want if w[:2] == mine[0][:2])[2])
        mine = sorted((a, b, sign * w, d) for a, b, w, d in mine)
        assert [(a, b, d) for a, b, _, d in mine] == [(a, b, d) for a, b, _, d in want]
        assert np.allclose([m[2] for m in mine], [w[2] for w in want], rtol=0, atol=1e-9)
        assert all(abs(r.explained - values[c] / total) < 1e-9 and 0 <= r.identity_error < 1e-9 for r in got if r.component == c + 1)


def test_whitening_of_few_equal_and_huge_rows(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(k, v, 0) for k, v in enumerate(ODD[:2])])).collect() == []
    assert whitening.whitened(vectors(spark, [(k, [1.0] * 8, 0) for k in range(5)])).collect() == []  # no variance
    line = whitening.whitened(vectors(spark, [(k, [float(k), 2.0 * k, 0.0], 0) for k in range(5)])).collect()
    assert {(r.component, round(r.explained, 12)) for r in line} == {(1, 1.0)} and len(line) == 5
    huge = whitening.whitened(vectors(spark, [(0, [3e38, 0.0], 0), (1, [-3e38, 1.0], 0), (2, [0.5, 0.0], 0)])).collect()
    assert {r.vec_id for r in huge} == {0, 1, 2} and {r.deviation for r in huge if r.vec_id < 2} == {None}


def test_exact_sums_beyond_64_bits():
    big = np.full((4, 2), 1 << 61, dtype=np.int64)
    assert whitening.exact_sums(big) == [1 << 63] * 2
    assert whitening.deviations(np.array([[1 << 40, 3]]), 10**6, [7, 1]) == [((10**6 << 40) - 7) ** 2 + (3 * 10**6 - 1) ** 2]


def plain_codes(rows, scale, parts, entries, rounds):
    """By loops over Python's numbers."""
    x = [[math.floor(float(np.float32(c)) * scale) for c in v] for _, v, _ in rows]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            codes = [near(c[p], books[p]) for c in cut]
            mean = lambda e, old: [sum(col) // len(col) for col in zip(*[c[p] for c, k in zip(cut, codes) if k == e])] or old  # noqa: B023, E731
            books[p] = [mean(e, old) for e, old in enumerate(books[p])]
    codes = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][k]) for p, k in enumerate(ks)) for c, ks in zip(cut, codes)]
    by = {}
    for (_, _, label), e in zip(rows, errors):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(i) for b in books for e in b for i in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for k in ks), e, by[r[2]], sha) for r, ks, e in zip(rows, codes, errors)]


@pytest.mark.parametrize("n,parts,rounds", [(150, 2, 6), (9, 8, 2), (40, 4, 0)])
def test_codes_equal_plain_loops(spark, n, parts, rounds):
    rows = made(n, n, kinds=30)
    rows += [(None, rows[0][1], None), (2, rows[2][1], 2), (2, rows[3][1], 2), (500, [1e9, *[0.0] * 6, -3e38], 0)][: 3 if rounds else 0]
    got = vector_codes.vector_codes(vectors(spark, rows + [(-k, v, 1) for k, v in enumerate(ODD)]), parts=parts, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_codes(rows, 4096, parts, 16, rounds), key=repr)


def test_codes_of_no_rows_and_ties(spark):
    assert vector_codes.vector_codes(vectors(spark, [])).collect() == []
    codes, far = vector_codes.nearest(np.array([[1, 0]], dtype=np.int32), np.array([[2], [0], [0]]))
    assert codes.tolist() == [0, 1] and far.tolist() == [1, 0]
    same = vector_codes.vector_codes(vectors(spark, [(k, [0.5] * 8, None) for k in range(40)])).collect()
    assert {r.code for r in same} == {"00" * 8} and {(r.error, r.label_error) for r in same} == {(0, 0)}
    with pytest.raises(ValueError):
        vector_codes.vector_codes(vectors(spark, [(1, [0.5] * 7, 0)]))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_query_leaves_files_behind_its_scope(spark, name, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_dir", lambda _: f"file://{tmp_path}")
    with scratch.scope(spark):
        queries.QUERIES[name](spark, DIR).write.format("noop").mode("overwrite").save()
    assert not [f for _, _, names in os.walk(tmp_path) for f in names]
