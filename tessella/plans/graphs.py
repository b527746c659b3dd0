"""Queries on graphs and plans (families O and P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cycles, graph, planning, walks
from .registry import query
from .tables import TREE, table, tree


@query(f"select kind, count(*) as n from (select substr(a, 1, 1) || substr(b, 1, 1) as kind from {TREE}) group by 1")
def graph_build(spark, d):
    """Typed edges of a property graph."""
    return tree(spark, d).groupBy(F.concat(F.substring("a", 1, 1), F.substring("b", 1, 1)).alias("kind")).agg(F.count("*").alias("n"))


@query(f"select id, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree from (select a as id, 1 as o, 0 as i from {TREE} union all select b, 0, 1 from {TREE}) group by 1")
def graph_degree(spark, d):
    """Degrees."""
    return graph.degrees(tree(spark, d))


@query(f"select 'n7' as id, b as neighbour, 'out' as direction from {TREE} where a = 'n7' union all select 'n7', a, 'in' from {TREE} where b = 'n7'")
def one_hop(spark, d):
    """Direct relations."""
    return graph.neighbours(tree(spark, d), spark.createDataFrame([("n7",)], "id string"))


@query(f"select id, min(depth) as depth from (select 'r1' as id, 0 as depth union all select b, 1 from {TREE} where a = 'r1' union all select e2.b, 2 from {TREE} e1 join {TREE} e2 on e2.a = e1.b where e1.a = 'r1') group by 1")
def bfs_depth(spark, d):
    """Depth by breadth-first search."""
    return graph.layers(tree(spark, d), spark.createDataFrame([("r1",)], "id string"), 2)


@query("select count(*) as n from (select c_nationkey as n, n_regionkey as r from customer join nation on n_nationkey = c_nationkey where c_custkey = 1) c, (select s_nationkey as n, n_regionkey as r from supplier join nation on n_nationkey = s_nationkey where s_suppkey = 1) s where c.r = s.r")
def shortest_path_none(spark, d):
    """How many paths there are between two nodes of a forest: none where their trees differ."""
    return graph.shortest_path(tree(spark, d), "c1", "s1").agg(F.count("*").alias("n"))


def _world(spark, d):
    """The tree under one root w."""
    e = tree(spark, d)
    return e.unionByName(e.where("a like 'r%'").select(F.lit("w").alias("a"), F.col("a").alias("b")).distinct())


@query("select 's1' as id, case when c.n = s.n then ['c1', 'n' || c.n, 's1'] when c.r = s.r then ['c1', 'n' || c.n, 'r' || c.r, 'n' || s.n, 's1'] else ['c1', 'n' || c.n, 'r' || c.r, 'w', 'r' || s.r, 'n' || s.n, 's1'] end as path from (select c_nationkey as n, n_regionkey as r from customer join nation on n_nationkey = c_nationkey where c_custkey = 1) c, (select s_nationkey as n, n_regionkey as r from supplier join nation on n_nationkey = s_nationkey where s_suppkey = 1) s")
def shortest_path(spark, d):
    """The shortest path, of equal ones the first."""
    return graph.shortest_path(_world(spark, d), "c1", "s1")


IDS = "(select n_regionkey as r, 'r' || n_regionkey as id from nation union select n_regionkey, 'n' || n_nationkey from nation union select n_regionkey, 'c' || c_custkey from customer join nation on n_nationkey = c_nationkey union select n_regionkey, 's' || s_suppkey from supplier join nation on n_nationkey = s_nationkey)"


@query(f"select min(id) as a, cast(count(*) as integer) as b from {IDS} group by r")
def components(spark, d):
    """The components of a forest, by their smallest id, with their sizes."""
    return graph.components(tree(spark, d)).groupBy(F.col("label").alias("a")).agg(F.count("*").cast("int").alias("b"))


@query("select case when n_regionkey = 0 then 'r0' else 'r' || n_regionkey end as region, count(*) as n from nation group by 1")
def component_sizes(spark, d):
    """Sizes of the components of the region and nation edges."""
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("a"), F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("b"))
    c = graph.components(n)
    return c.groupBy(F.col("label").alias("region")).agg((F.count("*") - 1).alias("n"))


@query("select 'r' || n_regionkey as a, 'n' || n_nationkey as b from supplier join nation on n_nationkey = s_nationkey where s_suppkey = 1 union all select 'n' || s_nationkey, 's1' from supplier where s_suppkey = 1 union all select 's1', 'r' || n_regionkey from supplier join nation on n_nationkey = s_nationkey where s_suppkey = 1")
def cycle_check(spark, d):
    """The cycle that one edge back to its root makes of a tree."""
    e = tree(spark, d)
    up = e.where("b = 's1'").select(F.col("a").alias("b")).join(e, "b").select(F.lit("s1").alias("a"), F.col("a").alias("b"))
    return cycles.cycle_edges(e.unionByName(up)).select("a", "b")


REACH = "r(s, x) as (select a, b from e union select r.s, e.b from r join e on e.a = r.x), comp as (select p.s as id, min(p.x) as c from r p join r q on q.s = p.x and q.x = p.s group by 1)"


@query(f"with recursive e as (select distinct l_partkey as a, l_suppkey as b from lineitem where l_partkey in (select l_suppkey from lineitem)), {REACH} select e.a, e.b, i.c as component from e join comp i on i.id = e.a join comp j on j.id = e.b and j.c = i.c")
def cycle_edges(spark, d):
    """Edges on cycles, with the strongly connected component."""
    return cycles.cycle_edges(table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))


#: Of each part the suppliers of its dearest and its cheapest line: two edges a node, with cycles among the small ids.
EXTREMES = "(select l_partkey as a, arg_max(l_suppkey, (l_extendedprice, l_suppkey)) as b from lineitem group by 1 union select l_partkey, arg_min(l_suppkey, (l_extendedprice, l_suppkey)) from lineitem group by 1)"


def _extremes(spark, d):
    price = F.struct("l_extendedprice", "l_suppkey")
    two = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("a")).agg(F.max_by("l_suppkey", price).alias("hi"), F.min_by("l_suppkey", price).alias("lo"))
    return two.select("a", F.explode(F.array_distinct(F.array("hi", "lo"))).alias("b"))


@query(
    f"with recursive e as {EXTREMES}, {REACH}, k as (select e.a, e.b, i.c from e join comp i on i.id = e.a join comp j on j.id = e.b and j.c = i.c),"
    " f(c, x, n) as (select distinct c, c, 0 from comp union select f.c, k.b, f.n + 1 from f join k on k.a = f.x and k.c = f.c where f.n < 64), df as (select c, x, min(n) as n from f group by 1, 2),"
    " g(c, x, n) as (select distinct c, c, 0 from comp union select g.c, k.a, g.n + 1 from g join k on k.b = g.x and k.c = g.c where g.n < 64), dg as (select c, x, min(n) as n from g group by 1, 2),"
    " len as (select df.c, min(df.n) + 1 as len from df join k on k.a = df.x and k.b = df.c group by 1),"
    " p(c, path, x, n) as (select c, [c], c, 0 from len union all select p.c, list_append(p.path, k.b), k.b, p.n + 1 from p join k on k.a = p.x and k.c = p.c join df on df.c = p.c and df.x = k.b and df.n = p.n + 1 join dg on dg.c = p.c and dg.x = k.b join len on len.c = p.c where dg.n + p.n + 1 = len.len)"
    " select p.c as component, min(list_append(p.path, p.c)) as cycle from p join k on k.a = p.x and k.b = p.c join len on len.c = p.c and len.len = p.n + 1 group by 1"
)
def canonical_cycles(spark, d):
    """One cycle of each strongly connected component: the shortest through its smallest node, then the first."""
    return cycles.canonical_cycles(_extremes(spark, d))


@query(
    f"with recursive e as (select a, b, a || '-' || b as edge from {EXTREMES} where a <> b), n as (select p_partkey as id, 1 + (p_size - 1) // 10 as band from part),"
    " bp as (select b as id, arg_min(a, (-coalesce(band, 99), a)) as nxt from e left join n on n.id = e.a group by 1), fp as (select a as id, arg_min(b, (coalesce(band, 99), b)) as nxt from e left join n on n.id = e.b group by 1),"
    " wb(anchor, path) as (select id, [id] from n union all select anchor, list_prepend(bp.nxt, path) from wb join bp on bp.id = path[1] where not list_contains(path, bp.nxt)), b as (select anchor, arg_max(path, len(path)) as path from wb group by 1),"
    " wf(anchor, path, back) as (select anchor, path, len(path) - 1 from b union all select anchor, list_append(path, fp.nxt), back from wf join fp on fp.id = path[-1] where not list_contains(path, fp.nxt)), w as (select anchor, arg_max(path, len(path)) as path, any_value(back) as back from wf group by 1 having max(len(path)) > 1),"
    " v as (select anchor, unnest(path) as id from w), t as (select anchor, count(distinct edge) as touched from (select v.anchor, e.edge from v join e on e.a = v.id union all select v.anchor, e.edge from v join e on e.b = v.id) group by 1)"
    " select anchor, back as n_before, len(path) - back - 1 as n_after, path[back] as before, path[back + 2] as after, path[1] as first, path[-1] as last, touched - len(path) + 1 as branches from w join t using (anchor)"
)
def progression_walks(spark, d):
    """The greedy progression around every node: predecessors from the highest band, successors in the lowest, branches left aside."""
    edges = _extremes(spark, d).where("a <> b").select(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("edge"), "a", "b")
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.lit(1) + F.floor((F.col("p_size") - 1) / 10)).cast("int").alias("band"))
    return walks.summarized(nodes, edges)


KINDS_OF_PARTS = "(select distinct 'w' as a, 'b:' || p_brand as b from part union select distinct 'b:' || p_brand, 't:' || p_type from part union select 'b:' || p_brand, 'p:' || p_partkey from part union select 't:' || p_type, 'p:' || p_partkey from part)"


@query(
    f"with recursive e as {KINDS_OF_PARTS}, w(id, path) as (select 'w', ['w'] union all select e.b, list_append(path, e.b) from w join e on e.a = w.id), p as (select 'p:' || p_partkey as id, case when p_size > 25 then ['w', 'b:' || p_brand, 't:' || p_type, 'p:' || p_partkey] when p_size > 20 then ['w', 't:' || p_type, 'p:' || p_partkey] end as liked from part),"
    " c as (select p.id, liked, count(*) as n_paths, coalesce(bool_or(path = liked), false) as has_liked, arg_min(path, (len(path), path)) as shortest from p join w on w.id = p.id group by 1, 2)"
    " select id, n_paths, case when has_liked then liked else shortest end as path, case when has_liked then 'preferred' else 'shortest' end as basis from c"
)
def taxonomy_all_paths(spark, d):
    """The root path of each leaf of a taxonomy with several parents: the preferred one where it is one of all, else the shortest, then the first; and how many there are."""
    p = table(spark, d, "part").select(F.concat(F.lit("b:"), "p_brand").alias("brand"), F.concat(F.lit("t:"), "p_type").alias("type"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), "p_size")
    edges = p.select(F.explode(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ((F.lit("w"), F.col("brand")), (F.col("brand"), F.col("type")), (F.col("brand"), F.col("id")), (F.col("type"), F.col("id")))])).alias("e")).select("e.*").distinct()
    liked = F.when(F.col("p_size") > 25, F.array(F.lit("w"), "brand", "type", "id")).when(F.col("p_size") > 20, F.array(F.lit("w"), "type", "id"))
    out = walks.resolve_paths(edges, p.select("id"), preferred=p.select("id", liked.alias("path")).where("path is not null"))
    return out.join(walks.path_counts(edges), "id").select("id", F.col("n_paths").cast("long").alias("n_paths"), "path", "basis")


@query(f"with s as (select 'r1' as id, 0 as depth union all select b, 1 from {TREE} where a = 'r1' union all select e2.b, 2 from {TREE} e1 join {TREE} e2 on e2.a = e1.b where e1.a = 'r1') select id, depth, (select greatest(count(*) - 12, 0) from s) as hidden from s order by depth, id limit 12")
def layers_budget(spark, d):
    """Layers within a budget of nodes."""
    seen = graph.layers(tree(spark, d), spark.createDataFrame([("r1",)], "id string"), 2)
    return graph.within_budget(seen, seen.select("id", F.col("id").alias("label")), 12).select("id", "depth", "hidden")


@query(f"select 'r' || n_regionkey as id, ['r' || n_regionkey] as path from (select distinct n_regionkey from nation) union all select b, [a, b] from {TREE} where a like 'r%' union all select e2.b, [e1.a, e1.b, e2.b] from {TREE} e1 join {TREE} e2 on e2.a = e1.b where e1.a like 'r%'")
def taxonomy_paths(spark, d):
    """Root paths."""
    return graph.root_paths(tree(spark, d))


@query("select o_custkey as grp, o_orderkey as a, nxt as b from (select o_custkey, o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as nxt from orders) where nxt is not null")
def prog_chain(spark, d):
    """Adjacent pairs of a progression."""
    return graph.chain_edges(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("with g as (select o_custkey, o_orderpriority as band, count(*) as n, min(o_orderkey) as k from orders group by 1, 2) select a.o_custkey, a.k as a, b.k as b, case when a.n = 1 and b.n = 1 then 'complete' else 'ambiguous' end as state from g a join g b on a.o_custkey = b.o_custkey and a.band = '1-URGENT' and b.band = '2-HIGH'")
def explicit_edges(spark, d):
    """O2: edges between bands that hold exactly one record, with a diagnosis."""
    g = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("band")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k"))
    a, b = g.where("band = '1-URGENT'").select("o_custkey", F.col("n").alias("na"), F.col("k").alias("a")), g.where("band = '2-HIGH'").select("o_custkey", F.col("n").alias("nb"), F.col("k").alias("b"))
    return a.join(b, "o_custkey").select("o_custkey", "a", "b", F.when((F.col("na") == 1) & (F.col("nb") == 1), "complete").otherwise("ambiguous").alias("state"))


@query("select rule, cast(n as bigint) as n from (select 'unknown_end' as rule, count(distinct x) as n from (select l_partkey as x from lineitem union select l_suppkey from lineitem) where x not in (select p_partkey from part where p_size > 5) union all select 'self_edge', count(*) from lineitem where l_partkey = l_suppkey union all select 'repeated_edge', count(*) from (select l_partkey, l_suppkey from lineitem group by 1, 2 having count(*) > 1)) where n > 0")
def graph_validation(spark, d):
    """Broken rules of a graph."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return graph.validate(table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("id")), e)


@query("select l_partkey as a, l_suppkey as b, count(*) as evidence, case when count(distinct l_returnflag) > 1 then 72 else 52 end as confidence from lineitem group by 1, 2")
def trust_relations(spark, d):
    """Pairs with how much speaks for them, in two steps of confidence."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.count("*").alias("evidence"), F.when(F.count_distinct("l_returnflag") > 1, 72).otherwise(52).alias("confidence"))


LINES = "(select conv_id, turn, trim(case when role = 'user' then 'Unit ' || (turn + 1) else 'goal:' end || ' ' || text) as line from conversations)"


@query(
    f"with l as (select conv_id, turn, nullif(trim(regexp_extract(line, '(?i)^(?:单元|Unit)\\s*([0-9一二三四五六七八九十]*)\\s*[.、:：-]?\\s*(.+)$', 2)), '') as title, nullif(trim(regexp_extract(line, '(?:学习目标|目标|goal)\\s*[:：]\\s*(.+)$', 1)), '') as goal from {LINES}),"
    " u as (select *, sum(case when title is not null then 1 else 0 end) over (partition by conv_id order by turn) as unit_no from l) select conv_id, cast(unit_no as bigint) as unit_no, max(title) as title, coalesce(list(goal order by turn, goal) filter (goal is not null and title is null), []) as goals from u where unit_no > 0 group by 1, 2"
)
def plan_parse(spark, d):
    """Plan lines to units with goals."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.when(F.col("role") == "user", F.concat(F.lit("Unit "), (F.col("turn") + 1).cast("string"))).otherwise(F.lit("goal:")), "text").alias("line"))
    return planning.parse_units(c, "conv_id", "turn", "line")


def _plan(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("unit"), F.col("l_suppkey").alias("code"), F.when(F.col("l_returnflag") == "R", "accepted").otherwise("rejected").alias("decision"))
    return li


@query("select code, count(*) as n_accepted, count(*) > 1 as is_duplicate from (select l_orderkey, l_linenumber, l_suppkey as code from lineitem group by 1, 2, 3 having max(case when l_returnflag = 'R' then 'accepted' else 'rejected' end) = 'accepted') group by 1")
def coverage(spark, d):
    """Coverage by accepted decisions."""
    li = _plan(spark, d)
    return planning.coverage(li, planning.latest_decisions(li, ["plan", "unit", "code"], "decision", "decision"), ["plan", "unit", "code"], "code")


@query("select l_partkey || '-' || l_suppkey as code from lineitem group by l_partkey, l_suppkey having count(*) filter (l_returnflag = 'R') = 0")
def gaps(spark, d):
    """Codes of the scope that nothing accepted covers."""
    li = table(spark, d, "lineitem").select(F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("code"), "l_returnflag")
    return planning.gaps(li, li.where("l_returnflag = 'R'"), "code")


@query("with u as (select l_orderkey as plan, count(*) as n from lineitem group by 1), p as (select plan, n, plan % 9 as weeks from u), w as (select plan, n, greatest(weeks, 1) as total, unnest(generate_series(1, greatest(weeks, 1))) as week from p) select plan, cast(week as integer) as week, case when week = 8 then 'exam' when week in (4, 8) then 'review' else 'teaching' end as type, case when week not in (4, 8) then cast(least(n - 1, ((week - 1) * n) // total) + 1 as integer) end as unit_no from w")
def schedule(spark, d):
    """Weeks with exams, reviews and units."""
    units = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"))
    plans = units.distinct().withColumn("weeks", (F.col("plan") % 9).cast("int"))
    return planning.schedule(plans, units, "plan", "weeks", [4, 8], [8])


@query("select l_orderkey, l_linenumber, cast((row_number() over (partition by l_orderkey order by l_linenumber) - 1) % 5 + 1 as integer) as day from lineitem")
def timetable(spark, d):
    """Lessons dealt over days."""
    return planning.timetable(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", ["l_linenumber"], 5)
