"""Row clustering against a plain loop, compatibility forms."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import canonical
from tessella.operators import layout


def plain(items):
    rows = []
    for i in sorted(items, key=lambda i: (-i["baseline"], i["x"], i["item"])):
        t = max(2.5, min(8, max(1, i["height"]) * 0.34))
        row = next((r for r in rows if abs(r["baseline"] - i["baseline"]) <= t), None)
        if row is None:
            row = {"baseline": i["baseline"], "items": []}
            rows.append(row)
        row["items"].append(i)
    out = []
    for r in sorted(rows, key=lambda r: -r["baseline"]):
        cells = sorted(r["items"], key=lambda i: i["x"])
        text, before = "", None
        for c in cells:
            if before and c["x"] - (before["x"] + before["width"]) > max(1.8, max(1, c["height"]) * 0.18):
                text += " "
            text, before = text + c["text"], c
        out.append((text, min(c["x"] for c in cells), max(c["x"] + c["width"] for c in cells)))
    return out


@pytest.mark.parametrize("step,spread", [(12, 3), (5, 4), (1, 1)])
def test_rows_equal_a_plain_loop(spark, step, spread):
    rng = random.Random(step)
    pages = {f"p{p}": [{"item": k, "text": f"t{k}", "x": float(rng.randrange(60)), "baseline": rng.randrange(1, 40) * step + rng.randrange(spread * 4) / 4, "width": float(rng.randrange(1, 9)), "height": float(rng.randrange(1, 40))} for k in range(rng.randrange(1, 120))] for p in range(4)}
    pages["one"] = [{"item": 0, "text": "x", "x": 0.0, "baseline": -7.0, "width": 1.0, "height": 5.0}]
    rows = [(p, i["item"], i["text"], i["x"], i["baseline"], i["width"], i["height"], 1) for p, items in pages.items() for i in items]
    rows += [("p0", 900, " ", 1.0, 5.0, 1.0, 9.0, 1), ("p0", 901, None, 1.0, 5.0, 1.0, 9.0, 1), ("p0", 902, "no place", None, 5.0, 1.0, 9.0, 1)]
    df = spark.createDataFrame(rows, "page string, item long, text string, x double, baseline double, width double, height double, run int").drop("run")
    got = {}
    for r in layout.rows(df).orderBy("page", "row").collect():
        got.setdefault(r.page, []).append((r.text, r.x0, r.x1))
    assert got == {p: plain(items) for p, items in pages.items()}
    assert layout.rows(df.where("false")).collect() == []


def test_compatibility_form(spark):
    df = spark.createDataFrame([("Ｕｎｉｔ　３ ﬁne①",), ("第二章　Ａ",), ("1.2.3 x  y",), (None,), ("",)], "t string")
    assert [r.c for r in df.select(canonical.heading_title(F.col("t")).alias("c")).collect()] == ["fine1", "a", "x y", None, ""]
