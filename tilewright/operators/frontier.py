"""Shortest paths of many requests at once, searched towards their targets by joins: no graph on the driver or in a task.

A state is a node reached from an origin in a mode. In a round the states that have improved go
some edges on; a state stays in the frontier only while it may still better a target of its origin:
while its cost, and the least time from it to the box of these targets, are no more than the dearest
of their costs so far. Requests of one origin and mode share a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geo, lookups

#: No road class is faster, km/h; a mode's own speed may be less.
FASTEST = max(lookups.CLASS_SPEED.values())
#: Straight lines are taken a little shorter than they are, as boxes are flat here and the earth is not.
SLACK = 0.99
KEY = ["mode", "origin"]


def by_mode(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mode, src, dst, step, x, y): seconds of each edge (src, dst, length_m, cls) for the modes that may use it, of parallel
    ones the fastest, with the place of its end."""
    each = F.array(*[F.when(lookups.is_accessible(F.col("cls"), m), F.struct(F.lit(m).alias("mode"), lookups.mode_weight(F.col("length_m"), F.col("cls"), m).alias("step"))) for m in lookups.MODE_SPEED])
    rows = edges.select("src", "dst", F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).groupBy("e.mode", "src", "dst").agg(F.min("e.step").alias("step"))
    return rows.join(nodes.select(F.col("node").alias("dst"), F.col("lng").alias("x"), F.col("lat").alias("y")), "dst").select("mode", "src", "dst", "step", "x", "y")


def _least_seconds() -> Column:
    """From a state (x, y) to the box of its origin's targets, at the mode's highest speed."""
    beyond = lambda v, a, b: F.greatest(F.col(a) - F.col(v), F.col(v) - F.col(b), F.lit(0.0))
    k = F.cos(F.radians(F.greatest(F.abs("y"), F.abs("south"), F.abs("north"))))
    metres = F.hypot(beyond("x", "west", "east") * k, beyond("y", "south", "north")) * geo.DEGREE_M * SLACK
    return metres / 1000 / F.least(lookups.lookup(lookups.MODE_SPEED, F.col("mode")), F.lit(FASTEST)) * 3600


def searched(wanted: DataFrame, own: DataFrame, nodes: DataFrame, hops: int = 4) -> DataFrame:
    """(mode, origin, node, cost, before): states reached for wanted (mode, origin, target), whose targets' costs are least.

    A target that can't be reached costs its origin's whole surroundings."""
    places = nodes.select(F.col("node").alias("target"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    boxes = wanted.join(places, "target").groupBy(*KEY).agg(F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north")).checkpoint()
    start = boxes.select(*KEY).join(nodes.select(F.col("node").alias("origin"), F.col("lng").alias("x"), F.col("lat").alias("y")), "origin")
    known = start.select(*KEY, F.col("origin").alias("node"), "x", "y", F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("before")).checkpoint()
    front = known
    while True:
        here, reached = front, known.withColumn("old", F.col("cost"))
        for _ in range(hops):
            onwards = here.select(*KEY, F.col("node").alias("src"), F.col("cost").alias("_c")).join(own, ["mode", "src"])
            here = onwards.groupBy(*KEY, F.col("dst").alias("node"), "x", "y").agg(F.min(F.struct((F.col("_c") + F.col("step")).alias("cost"), F.col("src").alias("before"))).alias("_b"))
            here = here.select(*KEY, "node", "x", "y", "_b.cost", "_b.before")
            reached = reached.unionByName(here.withColumn("old", F.lit(None).cast("double")))
        every = reached.groupBy(*KEY, "node", "x", "y").agg(F.min(F.struct("cost", "before")).alias("_b"), F.min("old").alias("old"))
        every = every.select(*KEY, "node", "x", "y", "_b.cost", "_b.before", "old").checkpoint()
        known = every.drop("old")
        costs = wanted.join(known.select(*KEY, F.col("node").alias("target"), "cost"), [*KEY, "target"], "left")
        limits = costs.groupBy(*KEY).agg(F.when(F.count("cost") == F.count("*"), F.max("cost")).alias("limit")).join(boxes, KEY)
        improved = every.where("old is null or cost < old").join(limits, KEY)
        front = improved.where(F.col("limit").isNull() | (F.col("cost") + _least_seconds() <= F.col("limit"))).select(*KEY, "node", "x", "y", "cost", "before").checkpoint()
        if front.isEmpty():
            return known


def paths(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(mode, origin, target, path) of the wanted targets that were reached: pointers to the node before are doubled, with the
    nodes they pass, and stop at the origin."""
    jumps = known.select(*KEY, "node", F.coalesce("before", "node").alias("to"), F.when(F.col("before").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("before")).alias("over")).checkpoint()
    rows = wanted.join(known.select(*KEY, F.col("node").alias("target")), [*KEY, "target"]).select(*KEY, "target", F.col("target").alias("node"), F.array("target").alias("path"))
    while True:
        rows = rows.join(jumps, [*KEY, "node"]).select(*KEY, "target", F.col("to").alias("node"), F.concat("path", "over").alias("path")).checkpoint()
        if rows.where("node <> origin").isEmpty():
            return rows.select(*KEY, "target", F.reverse("path").alias("path"))
        onwards = jumps.select(*KEY, F.col("node").alias("to"), F.col("to").alias("_to"), F.col("over").alias("_over"))
        jumps = jumps.join(onwards, [*KEY, "to"]).select(*KEY, "node", F.col("_to").alias("to"), F.concat("over", "_over").alias("over")).checkpoint()


def shortest_paths(requests: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cost, path, reason) for requests (id, origin, target, mode) over edges (src, dst, length_m, cls) between nodes
    (node, lng, lat): the fastest path by the mode's speeds over roads that it may use.

    reason is no-origin or no-destination for a place that no edge of any mode meets, no-path where none leads there. Of
    paths of one cost the one over the smallest nodes before each node is taken. Repeated requests each get a row; null
    places count as no-origin and no-destination, unknown modes as no-path."""
    asked = requests.select("id", "origin", "target", "mode")
    met = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(nodes.select("node").distinct(), "node", "left_semi").checkpoint()
    at = lambda what, flag: met.select(F.col("node").alias(what), F.lit(True).alias(flag))
    asked = asked.join(at("origin", "_o"), "origin", "left").join(at("target", "_t"), "target", "left").checkpoint()
    wanted = asked.where("_o and _t and mode is not null").select(*KEY, "target").distinct().checkpoint()
    known = searched(wanted, by_mode(edges, nodes).checkpoint(), nodes)
    found = paths(wanted, known).join(known.select(*KEY, F.col("node").alias("target"), "cost"), [*KEY, "target"])
    reason = F.when(F.col("_o").isNull(), "no-origin").when(F.col("_t").isNull(), "no-destination").when(F.col("cost").isNull(), "no-path")
    return asked.join(found, [*KEY, "target"], "left").select("id", "cost", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"), reason.alias("reason"))
