"""Planning a route over stored tiles in two passes: a coarse one over the trip's box, then one along its corridor."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geo, lookups, tiles
from tilewright.operators import graph, routes, store, tilegraph

#: Half width of the corridor and of what is loaded in detail, metres; caps of their tiles; where a trip may start or end.
CORRIDOR_M, DETAIL_M, CORRIDOR_CAP, DETAIL_CAP, SNAP_M = 2000.0, 2000.0, 1400, 500, 5000.0
#: From this zoom of the first pass on a second one isn't needed.
FINE_ZOOM = 13
SEGMENTS = "i int, ax double, ay double, bx double, by double, before double, n double"


class Plan(NamedTuple):
    """zoom of the first pass; the route's points and seconds, or why there is none; zooms its tiles are pinned at."""

    zoom: int
    reason: str | None
    points: list[tuple[float, float]]
    seconds: float | None
    fine: bool


def _point(node: int) -> tuple[float, float]:
    return (node // (1 << 23) - (1 << 23)) / graph.QUANT, (node % (1 << 23) - (1 << 22)) / graph.QUANT


def route_over(tile_rows: DataFrame, zoom: int, origin: tuple[float, float], target: tuple[float, float]) -> tuple[list[tuple[float, float]], float | None, str | None]:
    """(points, seconds, why not) of the fastest path over the roads of tiles (k, data), from node to node nearest by."""
    spark = tile_rows.sparkSession
    radius = spark.range(1).select(lookups.stitch_radius(F.lit(zoom)).alias("m")).first().m
    edges = tilegraph.graph(tile_rows, float(radius)).checkpoint()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    x, y = F.floor(F.col("node") / (1 << 23)) - (1 << 23), F.pmod("node", F.lit(1 << 23)) - (1 << 22)
    ranked = nodes.join(graph.node_rank(edges), "node", "left").select("node", (x / graph.QUANT).alias("lng"), (y / graph.QUANT).alias("lat"), F.coalesce("rank", F.lit(0)).alias("rank"))
    asked = spark.createDataFrame([(0, *origin), (1, *target)], "id int, lng double, lat double")
    at = {r.id: r.node for r in graph.nearest_node(asked, ranked, SNAP_M).collect()}
    if 0 not in at or 1 not in at:
        return [], None, "no-origin" if 0 not in at else "no-destination"
    request = spark.createDataFrame([(0, at[0], at[1])], "id long, origin long, target long")
    found = graph.shortest_paths(request, edges.select("src", "dst", F.col("seconds").alias("cost"))).first()
    return [_point(n) for n in found.path], found.cost, found.reason


def corridor_keys(spark: SparkSession, points: list[tuple[float, float]], turns: list[tuple[float, float]]) -> DataFrame:
    """(k): tiles of zoom 13 along a route and of zoom 14 round its ends and turns."""
    along = spark.createDataFrame(routes.segments(points), SEGMENTS)
    spots = spark.createDataFrame([(i, *p, *p, 0.0, 0.0) for i, p in enumerate([points[0], points[-1], *turns])], SEGMENTS)
    found = routes.corridor_within(along, 13, CORRIDOR_M, CORRIDOR_CAP)[0].unionByName(routes.corridor_within(spots, 14, DETAIL_M, DETAIL_CAP)[0])
    return found.select(tiles.tile_key(F.lit("planet"), F.col("z"), F.col("x"), F.col("y")).alias("k")).distinct()


def turns_of(points: list[tuple[float, float]], least: float = 25.0) -> list[tuple[float, float]]:
    """Points of a line at which it turns by so many degrees."""
    import math

    def bearing(a: tuple[float, float], b: tuple[float, float]) -> float:
        return math.degrees(math.atan2((b[0] - a[0]) * math.cos(math.radians(a[1])), b[1] - a[1]))

    return [b for a, b, c in zip(points, points[1:], points[2:], strict=False) if abs((bearing(b, c) - bearing(a, b) + 540) % 360 - 180) >= least]


def plan(stored: DataFrame, origin: tuple[float, float], target: tuple[float, float]) -> Plan:
    """A route between two places over the stored tiles (k, data).

    The first pass takes the tiles of the trip's padded box at a zoom that fits its length. Beyond FINE_ZOOM's reach a
    second pass takes the tiles along the route found; if it finds none, the first route stands. Reasons are too-far,
    no-data, no-origin, no-destination and no-path."""
    spark = stored.sparkSession
    o, t = [F.lit(v) for v in origin], [F.lit(v) for v in target]
    trip = spark.range(1).select(store.coarse_zoom(*o, *t).alias("c"), geo.haversine_m(*o, *t).alias("m")).first()
    zoom = trip.c.z
    if not trip.c.ok:
        return Plan(zoom, "too-far", [], None, False)
    box = geo.pad_bbox(F.least(o[0], t[0]), F.least(o[1], t[1]), F.greatest(o[0], t[0]), F.greatest(o[1], t[1]), F.lit(max(3000.0, trip.m * 0.08)))
    wanted = spark.range(1).select(F.explode(tiles.tiles_in_bbox(*box, F.lit(zoom))).alias("t")).select(tiles.tile_key(F.lit("planet"), F.lit(zoom), F.col("t.x"), F.col("t.y")).alias("k"))
    coarse = stored.join(wanted, "k", "left_semi").where(F.length("data") > 0)
    if not coarse.limit(1).count():
        return Plan(zoom, "no-data", [], None, False)
    points, seconds, reason = route_over(coarse, zoom, origin, target)
    if reason or zoom >= FINE_ZOOM or len(points) < 2:
        return Plan(zoom, reason, points, seconds, False)
    fine = stored.join(corridor_keys(spark, points, turns_of(points)), "k", "left_semi").where(F.length("data") > 0)
    if fine.limit(1).count():
        better, its_seconds, why = route_over(fine, FINE_ZOOM, origin, target)
        if why is None:
            return Plan(zoom, None, better, its_seconds, True)
    return Plan(zoom, None, points, seconds, False)
