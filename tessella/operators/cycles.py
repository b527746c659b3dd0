"""Strongly connected components, the edges on cycles, and one cycle of each component, over edges(a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize


def peeled(edges: DataFrame) -> DataFrame:
    """Distinct edges that remain when nodes that nothing leads to, or that lead nowhere, are taken away until none is left."""
    left = materialize(edges.select("a", "b").where("a is not null and b is not null").distinct(), "peel")
    n = left.count()
    while n:
        new = materialize(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "peel")
        discard(left)
        left, before, n = new, n, new.count()
        if n == before:
            break
    return left


def _colours(edges: DataFrame) -> DataFrame:
    """(id, colour): the smallest id from which a node is reached, its own included."""
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    colours = materialize(ends.withColumn("colour", F.col("id")), "colours")
    while True:
        near = edges.join(colours.select(F.col("id").alias("a"), "colour"), "a").groupBy(F.col("b").alias("id")).agg(F.min("colour").alias("near"))
        new = materialize(colours.join(near, "id", "left").select("id", F.col("colour").alias("old"), F.least("colour", "near").alias("colour")), "colours")
        settled = new.where("old <> colour").isEmpty()
        discard(colours)
        colours = new
        if settled:
            return colours.select("id", "colour")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node on a cycle: the smallest id of those that it reaches and that reach it.

    Forward-backward colouring: colours spread forwards until each node has the smallest id that leads
    to it; of a colour, what leads back to the node that gave it is one component. All colours are
    worked on at once, components are taken out, and what remains is peeled and coloured again. A self
    edge is a cycle; repeated edges and edges with a null end do no harm; no cycle gives no rows.
    """
    left, found = peeled(edges), None
    while not left.isEmpty():
        colours = materialize(_colours(left), "colour")
        same = left.join(colours.select(F.col("id").alias("a"), "colour"), "a").join(colours.select(F.col("id").alias("b"), F.col("colour").alias("other")), "b").where("colour = other")
        same = materialize(same.select("a", "b", "colour"), "same")
        back = front = materialize(colours.where("id = colour"), "back")
        while not front.isEmpty():
            step = same.join(front.select(F.col("id").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("id"), "colour").distinct()
            front = materialize(step.join(back, ["id", "colour"], "left_anti"), "front")
            old, back = back, materialize(back.unionByName(front), "back")
            discard(old)
        # A root that nothing leads back to has no cycle of its own.
        cyclic = back.join(same.select(F.col("b").alias("id"), "colour").distinct(), ["id", "colour"], "left_semi")
        part = materialize(cyclic.join(same.join(back.select(F.col("id").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("id"), "colour").distinct(), ["id", "colour"], "left_semi").select("id", F.col("colour").alias("component")), "component")
        found = part if found is None else found.unionByName(part)
        done = back.select("id")
        rest = left.join(done.withColumnRenamed("id", "a"), "a", "left_anti").join(done.withColumnRenamed("id", "b"), "b", "left_anti")
        new = peeled(rest)
        discard(left, colours, same, back)
        left = new
    discard(left)
    return found if found is not None else edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)


def cycle_edges(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(a, b, component): distinct edges that lie on a cycle; those that lead from one cycle to another don't."""
    c = strong_components(edges) if components is None else components
    on = edges.select("a", "b").distinct().join(c.select(F.col("id").alias("a"), "component"), "a")
    return on.join(c.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").where("component = other").select("a", "b", "component")


def canonical_cycles(edges: DataFrame) -> DataFrame:
    """(component, cycle): of each component the shortest cycle through its smallest node, of equal ones the first by order of its nodes; the node stands at both ends.

    A search from all smallest nodes at once, each within its component, which ends for a component
    when its first cycle closes."""
    on = materialize(cycle_edges(edges), "cycle-edges")
    front = materialize(on.select("component").distinct().select("component", F.col("component").alias("id"), F.array("component").alias("path")), "cycle-front")
    seen, found = front.select("component", "id"), None
    while not front.isEmpty():
        step = front.join(on.select("component", F.col("a").alias("id"), "b"), ["component", "id"])
        closed = materialize(step.where("b = component").groupBy("component").agg(F.min("path").alias("path")).select("component", F.concat("path", F.array("component")).alias("cycle")), "cycles")
        found = closed if found is None else found.unionByName(closed)
        new = step.join(closed.select("component"), "component", "left_anti").join(seen.select("component", F.col("id").alias("b")), ["component", "b"], "left_anti")
        front = materialize(new.groupBy("component", F.col("b").alias("id")).agg(F.min("path").alias("path")).select("component", "id", F.concat("path", F.array("id")).alias("path")), "cycle-front")
        seen = materialize(seen.unionByName(front.select("component", "id")), "cycle-seen")
    return found if found is not None else on.select("component", F.array("component").alias("cycle")).limit(0)
