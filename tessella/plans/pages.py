"""Queries on page layout and labels (families H, J and L)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import layout
from .registry import query
from .tables import table

#: Text items of pages: a page of a supplier and line number, baselines in quarters of a point.
ITEMS = "(select l_suppkey || '/' || l_linenumber as page, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey as item, l_returnflag || l_linestatus as text, floor(l_extendedprice)::bigint % 97 as x, floor(l_extendedprice * 100 + 0.5)::bigint % 1600 / 4.0 as baseline, 6 as width, 2 + floor(l_quantity)::bigint % 29 as height from lineitem)"


def _items(spark, d):
    li = table(spark, d, "lineitem")
    price = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    return li.select(F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("page"), (F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("item"), F.concat("l_returnflag", "l_linestatus").alias("text"), (F.floor("l_extendedprice") % 97).alias("x"), (price % 1600 / 4.0).alias("baseline"), F.lit(6).alias("width"), (2 + F.floor("l_quantity") % 29).alias("height"))


@query(
    f"with recursive i as (select *, greatest(2.5, least(8.0, greatest(1, height) * 0.34)) as tol, row_number() over (partition by page order by baseline desc, x, item) as k from {ITEMS}),"
    " f(page, k, item, base, bases) as (select page, k, item, baseline, [baseline] from i where k = 1 union all select i.page, i.k, i.item, coalesce(list_filter(f.bases, lambda r: abs(r - i.baseline) <= i.tol)[1], i.baseline), case when len(list_filter(f.bases, lambda r: abs(r - i.baseline) <= i.tol)) > 0 then f.bases else list_append(f.bases, i.baseline) end from f join i on i.page = f.page and i.k = f.k + 1),"
    " c as (select f.base, i.*, lag(i.x + i.width) over (partition by f.page, f.base order by i.x, i.baseline desc, i.item) as before from f join i on i.page = f.page and i.k = f.k),"
    " r as (select page, base, string_agg(case when x - before > greatest(1.8, height * 0.18) then ' ' else '' end || text, '' order by x, baseline desc, item) as text, min(x)::double as x0, min(greatest(0, baseline - height))::double as y0, max(x + width)::double as x1, max(greatest(0, baseline - height) + height)::double as y1 from c group by 1, 2)"
    " select page, cast(row_number() over (partition by page order by base desc) as integer) as row, text, x0, y0, x1, y1 from r"
)
def page_rows(spark, d):
    """Items of pages clustered to rows by baseline, each item with its own tolerance; their texts and boxes."""
    return layout.rows(_items(spark, d))


# Words of the parts' names, as labels in Chinese.
WORDS = {"anvil": "砧", "blue": "蓝", "bolt": "螺栓", "cold": "冷", "gear": "齿轮", "gizmo": "小件", "green": "绿", "hot": "热", "large": "大", "new": "新", "old": "旧", "red": "红", "rod": "杆", "small": "小", "widget": "部件"}


@query(f"with l as (select p_partkey as id, p_brand, {reduce(lambda sql, w: f'''replace({sql}, '{w}', '{WORDS[w]}')''', sorted(WORDS), 'p_name')} as label from part) select id, label, cast(row_number() over (partition by p_brand order by label collate zh, id) as integer) as place from l")
def collated_labels(spark, d):
    """H7: labels in the order of a Chinese dictionary, then by id."""
    label = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit(WORDS[w])), sorted(WORDS), F.col("p_name"))
    w = Window.partitionBy("p_brand").orderBy(F.collate("label", "zh"), "id")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", label.alias("label")).select("id", "label", F.row_number().over(w).alias("place"))




@query("select p_partkey, lower(upper(p_brand)) || ' ' || p_name as title from part")
def heading_titles(spark, d):
    """Titles in compatibility form, without the number of their heading."""
    wide = F.translate(F.upper("p_brand"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ０１２３４５６７８９＃")
    number = F.element_at(F.array(*map(F.lit, ("第三章　", "Ｕｎｉｔ　１２ ", "１．２　", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", canonical.heading_title(F.concat(number, wide, F.lit("　"), "p_name")).alias("title"))
