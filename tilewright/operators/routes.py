"""Operators on routes (lists of points) and on fixes along them."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions import geo, tiles
from tilewright.operators import greedy

Route = list[tuple[float, float]]
#: Segments that project_onto_path spells out.
INLINE = 8


def haversine(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[1]), math.radians(b[1])
    s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.R * math.asin(min(1.0, math.sqrt(s)))


def planar(a: tuple[float, float], b: tuple[float, float]) -> float:
    return math.hypot(math.radians(b[0] - a[0]) * math.cos(math.radians(a[1])), math.radians(b[1] - a[1])) * geo.R


def segments(route: Route, length=haversine) -> list[tuple[int, float, float, float, float, float, float]]:
    """(index, ax, ay, bx, by, length before, length) of each segment."""
    out, before = [], 0.0
    for i, (a, b) in enumerate(zip(route, route[1:], strict=False)):
        n = length(a, b)
        out.append((i, *a, *b, before, n))
        before += n
    return out


def project_onto_path(lng: Column, lat: Column, route: Route) -> Column:
    """struct(dist_m, index, t, along_m) of the nearest segment, the first of equals; null for no route. A route of one
    point is that point. The route is a literal, so the projection stays in the scan's stage: of up to INLINE segments
    as generated code, of more as one array that a lambda walks, so that the expression doesn't grow with the route."""
    if not route:
        return F.lit(None).cast("struct<dist_m:double,index:int,t:double,along_m:double>")
    if len(route) == 1:
        return F.struct(geo.haversine_m(lng, lat, F.lit(route[0][0]), F.lit(route[0][1])).alias("dist_m"), F.lit(0).alias("index"), F.lit(0.0).alias("t"), F.lit(0.0).alias("along_m"))
    if len(route) - 1 > INLINE:
        names = ("i", "ax", "ay", "bx", "by", "before", "n")
        table = F.from_json(F.lit(json.dumps([dict(zip(names, s, strict=True)) for s in segments(route)])), "array<struct<i:int,ax:double,ay:double,bx:double,by:double,before:double,n:double>>")

        def project(s: Column) -> Column:
            t, d = geo.segment_projection(lng, lat, s["ax"], s["ay"], s["bx"], s["by"])
            return F.struct(d.alias("dist_m"), s["i"].alias("index"), t.alias("t"), (s["before"] + t * s["n"]).alias("along_m"))

        return F.array_min(F.transform(table, project))
    found = []
    for i, ax, ay, bx, by, before, n in segments(route):
        t, d = geo.segment_projection(lng, lat, F.lit(ax), F.lit(ay), F.lit(bx), F.lit(by))
        found.append(F.struct(d.alias("dist_m"), F.lit(i).alias("index"), t.alias("t"), (F.lit(before) + t * F.lit(n)).alias("along_m")))
    return F.array_min(F.array(*found))


def point_at_distance(metres: Column, route: Route) -> Column:
    """struct(lng, lat) that far along the route, by planar lengths; the last point beyond its end."""
    out = F.struct(F.lit(route[-1][0]).alias("lng"), F.lit(route[-1][1]).alias("lat"))
    for _, ax, ay, bx, by, before, n in reversed(segments(route, planar)):
        t = F.lit(0.0) if n == 0 else (metres - before) / n
        out = F.when(metres <= before + n, F.struct((ax + t * (bx - ax)).alias("lng"), (ay + t * (by - ay)).alias("lat"))).otherwise(out)
    return out


def slice_route(start: Column, end: Column, route: Route) -> Column:
    """The point at start and then each vertex whose segment ends after start while it begins before end."""
    total = sum(s[-1] for s in segments(route))
    a = F.greatest(F.lit(0.0), F.least(start, F.lit(total)))
    b = F.greatest(a, F.least(end, F.lit(total)))
    kept = [F.when((F.lit(before + n) > a) & (F.lit(before) < b), F.struct(F.lit(bx).alias("lng"), F.lit(by).alias("lat"))) for _, _, _, bx, by, before, n in segments(route, planar)]
    return F.concat(F.array(point_at_distance(a, route)), F.filter(F.array(*kept), lambda p: p.isNotNull()))


def off_threshold(accuracy: Column) -> Column:
    return F.greatest(F.lit(35.0), accuracy * 1.8)


def deviation(fixes: DataFrame, route: Route, trip: str = "trip_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Adds dist_m, along_m, off and off_count: +1 for each fix off the route, -1 but not under 0 otherwise.

    With S the running sum of +1 and -1, the counter is S - min(0, least S so far): two windows over a trip, no loop."""
    w = Window.partitionBy(trip).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    p = fixes.withColumn("_p", project_onto_path(F.col("lng"), F.col("lat"), route))
    p = p.withColumn("dist_m", F.col("_p.dist_m")).withColumn("along_m", F.col("_p.along_m")).withColumn("off", F.col("_p.dist_m") > off_threshold(F.col("accuracy")))
    p = p.withColumn("_s", F.sum(F.when(F.col("off"), 1).otherwise(-1)).over(w))
    return p.withColumn("off_count", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_p", "_s")


def corridor_tiles(segs: DataFrame, z: int, radius: float) -> DataFrame:
    """Distinct tiles whose centre is within radius plus half a tile of a segment (ax, ay, bx, by): candidates are the
    tiles of each segment's padded box, so the join with tiles is an explode and a filter."""
    box = geo.pad_bbox(F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"), F.lit(radius * 2.0))
    zc = F.lit(z)
    half = 360.0 / 2**z * geo.DEGREE_M * F.cos(F.radians(F.col("ay"))) / 2
    cand = segs.select("*", half.alias("half"), F.explode(tiles.tiles_in_bbox(*box, zc)).alias("t")).select("*", "t.x", "t.y")
    cx, cy = tiles.tile_center(F.col("x"), F.col("y"), zc)
    near = geo.point_segment_m(cx, cy, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= radius + F.col("half")
    return cand.where(near).select(zc.alias("z"), "x", "y").distinct()


def corridor_within(segs: DataFrame, z: int, radius: float, cap: int) -> tuple[DataFrame, float]:
    """The corridor at the largest radius of radius * 0.55 ** i (200 at least) that has no more than cap tiles."""
    while True:
        found = corridor_tiles(segs, z, radius)
        if radius <= 200 or found.limit(cap + 1).count() <= cap:
            return found, radius
        radius = max(200.0, radius * 0.55)


#: Radii of corridors shrink by this, down to RADIUS_LEAST metres.
SHRINK, RADIUS_LEAST = 0.55, 200.0


def radii(radius: float) -> list[float]:
    """The radii that are tried, from the largest on."""
    out = [radius]
    while out[-1] > RADIUS_LEAST:
        out.append(max(RADIUS_LEAST, out[-1] * SHRINK))
    return out


def legs(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, i, ax, ay, bx, by, before, n, total, lat, last): the segments of each key's line through its points (lng, lat)
    in the order, with planar lengths; total by great circles, lat the mean of the points' latitudes, last the last."""
    w = Window.partitionBy(key).orderBy(*order)
    every = Window.partitionBy(key)
    rows = points.select(key, (F.row_number().over(w) - 1).alias("i"), F.col("lng").alias("ax"), F.col("lat").alias("ay"), F.lead("lng").over(w).alias("bx"), F.lead("lat").over(w).alias("by"), F.avg("lat").over(every).alias("lat"), *order)
    rows = rows.where("bx is not null").withColumn("n", geo.planar_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).withColumn("_m", geo.haversine_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.select(key, "i", "ax", "ay", "bx", "by", before.alias("before"), "n", F.sum("_m").over(every).alias("total"), "lat", F.lead("i").over(w).isNull().alias("last"))


def spaced(segs: DataFrame, step: Column, most: Column, key: str) -> DataFrame:
    """(key, k, lng, lat): the points of each line at k * step metres for k from 0 to most; the end beyond the end.

    segs as legs() has them. A segment makes the points that lie on it, so lines and points aren't joined."""
    rows = segs.withColumn("_step", step.cast("double")).withColumn("_most", most.cast("long"))
    first = F.when(F.col("i") == 0, 0).otherwise(F.floor(F.col("before") / F.col("_step"))).cast("long")
    until = F.when(F.col("last"), F.col("_most")).otherwise(F.least(F.col("_most"), F.ceil((F.col("before") + F.col("n")) / F.col("_step")).cast("long")))
    rows = rows.withColumn("_first", first).withColumn("_until", until).where("_first <= _until").withColumn("k", F.explode(F.sequence("_first", "_until")))
    at = F.col("k") * F.col("_step")
    rows = rows.where(((F.col("i") == 0) & (F.col("k") == 0) | (at > F.col("before"))) & (F.col("last") | (at <= F.col("before") + F.col("n"))))
    t = F.when(F.col("n") > 0, F.least(F.lit(1.0), (at - F.col("before")) / F.col("n"))).otherwise(F.when(F.col("last") & (at > F.col("before")), 1.0).otherwise(0.0))
    return rows.withColumn("_t", t).select(key, "k", (F.col("ax") + F.col("_t") * (F.col("bx") - F.col("ax"))).alias("lng"), (F.col("ay") + F.col("_t") * (F.col("by") - F.col("ay"))).alias("lat"))


def clipped(segs: DataFrame, start: Column, end: Column) -> DataFrame:
    """The segments of each line (as legs() has them) from start to end metres: the first begins at start, the last is
    the one in which the end lies, and stays whole."""
    rows = segs.withColumn("_a", F.greatest(F.lit(0.0), F.least(start, F.col("total")))).withColumn("_b", F.greatest("_a", F.least(end, F.col("total"))))
    rows = rows.where((F.col("before") + F.col("n") > F.col("_a")) & (F.col("before") < F.col("_b")))
    t = F.when(F.col("before") < F.col("_a"), (F.col("_a") - F.col("before")) / F.col("n")).otherwise(0.0)
    rows = rows.withColumn("_t", t).withColumn("_x", F.col("ax") + F.col("_t") * (F.col("bx") - F.col("ax"))).withColumn("_y", F.col("ay") + F.col("_t") * (F.col("by") - F.col("ay")))
    return rows.withColumn("ax", F.col("_x")).withColumn("ay", F.col("_y")).drop("_a", "_b", "_t", "_x", "_y")


#: Tiles that a task looks at together.
TILES_AT_ONCE = 1 << 19


def _stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of sizes that come to no more than most, or are one."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, first[i] + 0, 1, ... count[i] - 1) for all i."""
    i = np.repeat(np.arange(len(count)), count)
    return i, first[i] + np.arange(len(i)) - (np.cumsum(count) - count)[i]


def _least(code: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, each with its least need."""
    order = np.argsort(code, kind="stable")
    code, need = code[order], need[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[starts], np.minimum.reduceat(need, starts) if len(code) else need


def _needs(legs: np.ndarray, boxes: np.ndarray, z: int, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(leg, tile, need) of the tiles in each leg's box whose centre comes within radius of it, half a tile off: tile is
    y * 2 ** z + x, need the distance without the half. legs: rows ax, ay, bx, by; boxes: rows x0, x1, y0, y1."""
    n = 2**z
    ax, ay, bx, by = legs
    x0, x1, y0, y1 = boxes
    half = 360.0 / n * geo.DEGREE_M * np.cos(np.radians(ay)) / 2
    of, columns = _spread(x0, x1 - x0 + 1)
    for a, b in _stretches((y1 - y0 + 1)[of], TILES_AT_ONCE):
        part = of[a:b]
        i, y = _spread(y0[part], (y1 - y0 + 1)[part])
        leg, x = part[i], columns[a:b][i] % n
        lng = ((x / n * 360 - 180) + ((x + 1) / n * 360 - 180)) / 2
        least = int(y.min())
        north = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * np.arange(least, y.max() + 2) / n))))
        centre = (north[:-1] + north[1:]) / 2
        lat, k = centre[y - least], np.cos(np.radians(centre))[y - least]
        dx, dy = (bx - ax)[leg] * k * geo.DEGREE_M, ((by - ay) * geo.DEGREE_M)[leg]
        px, py = (lng - ax[leg]) * k * geo.DEGREE_M, (lat - ay[leg]) * geo.DEGREE_M
        size = dx * dx + dy * dy
        t = np.clip(np.divide(px * dx + py * dy, size, out=np.zeros(len(size)), where=size > 0), 0.0, 1.0)
        need = np.hypot(px - t * dx, py - t * dy) - half[leg]
        near = need <= radius
        yield leg[near], y[near] * n + x[near], need[near]


def corridors(segs: DataFrame, key: str, z: int, radius: float, cap: int) -> DataFrame:
    """(key, z, x, y, radius): the tiles of each key's corridor, at the largest of radii(radius) that has no more than cap.

    How near a tile's centre comes to a key's line, half a tile off, says in which corridors it is, so all radii are
    counted in one pass. A window brings the legs of a key together and marks its last; tasks go through them in order
    and hold the tiles of TILES_AT_ONCE legs' boxes and those of the key that goes on, so that what is shuffled and
    sorted is the legs, not their tiles."""
    box = geo.pad_bbox(F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"), F.lit(radius * 2.0))
    zc, n = F.lit(z), 2**z
    rows = segs.dropna(subset=["ax", "ay", "bx", "by"]).select(key, "ax", "ay", "bx", "by", *[c.alias(name) for c, name in zip(box, ("_w", "_s", "_e", "_n"), strict=True)])
    rows = rows.select(key, "ax", "ay", "bx", "by", tiles.tile_x(F.col("_w"), zc).alias("_x0"), tiles.tile_x(F.col("_e"), zc).alias("_x1"), F.greatest(tiles.tile_y(F.col("_n"), zc), F.lit(0)).alias("_y0"), F.least(tiles.tile_y(F.col("_s"), zc), F.lit(n - 1)).alias("_y1"))
    rows = rows.where("_y0 <= _y1").withColumn("_last", F.lead(F.lit(True)).over(Window.partitionBy(key).orderBy("ax", "ay", "bx", "by")).isNull())
    tried = radii(radius)
    none = np.zeros(0, np.int64), np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = none  # tiles and needs of the key that goes on
        for batch in batches:
            legs = np.stack([batch.column(i).to_numpy() for i in range(1, 5)])
            boxes = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5, 9)])
            last = batch.column(9).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in _stretches((boxes[1] - boxes[0] + 1) * (boxes[3] - boxes[2] + 1), TILES_AT_ONCE):
                ends = a + np.flatnonzero(last[a:b])
                line = np.concatenate([[0], np.cumsum(last[a : b - 1])])
                found = [kept]
                for leg, tile, need in _needs(legs[:, a:b], boxes[:, a:b], z, radius):
                    found.append(_least(line[leg] * n * n + tile, need))
                code, need = _least(*[np.concatenate(c) for c in zip(*found, strict=True)])
                done = int(np.searchsorted(code, len(ends) * n * n))
                kept = code[done:] - len(ends) * n * n, need[done:]
                line, tile, need = code[:done] // (n * n), code[:done] % (n * n), need[:done]
                if not done:
                    continue
                fits = np.full(len(ends), tried[-1])
                for r in tried[-2::-1]:
                    fits[np.bincount(line[need <= r], minlength=len(ends)) <= cap] = r
                inside = need <= fits[line]
                line, tile = line[inside], tile[inside]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ends[line])), pa.array(np.full(len(tile), z, np.int32)), pa.array((tile % n).astype(np.int32)), pa.array((tile // n).astype(np.int32)), pa.array(fits[line])], names=[key, "z", "x", "y", "radius"])

    return rows.mapInArrow(run, f"`{key}` {segs.schema[key].dataType.simpleString()}, z int, x int, y int, radius double")


def sliced(route: Route, start: float, end: float) -> Route:
    """slice_route() for plain numbers: the route's points from start to end, by planar lengths."""
    total = sum(s[-1] for s in segments(route))
    a = max(0.0, min(start, total))
    b = max(a, min(end, total))

    def at(m: float) -> tuple[float, float]:
        for _, ax, ay, bx, by, before, n in segments(route, planar):
            if before + n >= m:
                t = (m - before) / n if n else 0.0
                return ax + t * (bx - ax), ay + t * (by - ay)
        return route[-1]

    return [at(a), *[(bx, by) for _, _, _, bx, by, before, n in segments(route, planar) if before + n > a and before < b]]


#: How long ahead tiles are fetched, in seconds, and up to how many.
AHEAD_S, AHEAD_CAP = 480.0, 400


def predictive(spark, route: Route, along_m: float, speed_mps: float, detail_m: float) -> DataFrame:
    """Tiles of zoom 14 round what lies ahead: three times detail_m at least, or what AHEAD_S at that speed reach."""
    ahead = sliced(route, along_m - detail_m, along_m + max(3 * detail_m, speed_mps * AHEAD_S))
    segs = spark.createDataFrame(segments(ahead), "i int, ax double, ay double, bx double, by double, before double, n double")
    return corridor_within(segs, 14, detail_m, AHEAD_CAP)[0]


def off_road(fixes: DataFrame, after_s: int, metres: float = 90.0, turn: float = 35.0, speed_mps: float = 14.0) -> DataFrame:
    """Simulated fixes (trip_id, t, lng, lat) that leave the road after_s: a jump of `metres` to the right of the heading
    there, and on from it at `turn` degrees to the heading."""
    w = Window.partitionBy("trip_id").orderBy("t")
    f = fixes.withColumn("b", geo.bearing_deg(F.lag("lng").over(w), F.lag("lat").over(w), F.col("lng"), F.col("lat")))
    left = f.where(F.col("t") == after_s).select("trip_id", F.col("lng").alias("x"), F.col("lat").alias("y"), "b")
    x, y = geo.destination(F.col("x"), F.col("y"), F.col("b") + 90, F.lit(metres))
    left = left.select("trip_id", x.alias("x"), y.alias("y"), "b")
    u, v = geo.destination(F.col("x"), F.col("y"), F.col("b") + turn, (F.col("t") - after_s) * speed_mps)
    off = fixes.where(F.col("t") >= after_s).join(left, "trip_id").select("trip_id", "t", u.alias("lng"), v.alias("lat"))
    return fixes.where(F.col("t") < after_s).unionByName(off)


def said(events: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """Utterances (key, ts_ms, event_id, interrupt) that are spoken: those that interrupt, and others gap_ms at least after
    the last that was spoken; the rest are lost."""
    own = events.select(key, "ts_ms", "event_id", "interrupt")
    return greedy.counting(own, key, ["ts_ms", "event_id"], F.floor(F.col("ts_ms") / (gap_ms * greedy.FAN)), gap_ms, always=F.col("interrupt"))


def simplified(points: DataFrame, key: str, order: list[str], tolerance_m: float, bucket: Column | None = None) -> DataFrame:
    """The points (key, order, lng, lat) of each key's line that Douglas and Peucker keep.

    All lines' open stretches are looked at together: in a round each is split at its farthest point, or done with if
    that is within tolerance_m. Points of a stretch are in many tasks; what a round joins to them is its farthest one.
    bucket grows with the first order column, for numbering the points of a line in many tasks (greedy.numbered)."""
    own = greedy.numbered(points.select(key, *order, "lng", "lat"), key, order, F.lit(0) if bucket is None else bucket).checkpoint()
    ends = own.groupBy(key).agg(F.min_by("lat", "n").alias("_lat"), F.max("n").alias("_b"))
    k = F.cos(F.radians("_lat"))
    flat = own.join(ends, key).select(key, "n", (F.col("lng") * geo.DEGREE_M * k).alias("x"), (F.col("lat") * geo.DEGREE_M).alias("y"), "_b").checkpoint()
    edge = flat.groupBy(key).agg(*[F.max(F.when(F.col("n") == at, F.struct("n", "x", "y"))).alias(name) for name, at in (("a", F.lit(0)), ("b", F.col("_b")))])
    kept = edge.select(key, F.explode(F.array_distinct(F.array("a.n", "b.n"))).alias("n"))
    open_ = flat.where("n > 0 and n < _b").select(key, "n", "x", "y").join(edge, key)
    while not open_.isEmpty():
        dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
        px, py, size = F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y"), dx * dx + dy * dy
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / size))).otherwise(0.0)
        far = open_.withColumn("_t", t).select(key, "a", "b", "n", "x", "y", F.hypot(px - F.col("_t") * dx, py - F.col("_t") * dy).alias("_d"))
        split = far.groupBy(key, F.col("a.n").alias("_an")).agg(F.max(F.struct("_d", (-F.col("n")).alias("_n"), "x", "y")).alias("_f")).where(F.col("_f._d") > tolerance_m)
        split = split.select(key, "_an", F.struct((-F.col("_f._n")).alias("n"), "_f.x", "_f.y").alias("m")).checkpoint()
        kept = kept.unionByName(split.select(key, "m.n")).checkpoint()
        rest = open_.withColumn("_an", F.col("a.n")).join(split, [key, "_an"]).where(F.col("n") != F.col("m.n"))
        first = F.col("n") < F.col("m.n")
        open_ = rest.select(key, "n", "x", "y", F.when(first, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(first, F.col("m")).otherwise(F.col("b")).alias("b")).checkpoint()
    return own.join(kept, [key, "n"]).select(key, *order, "lng", "lat")


def simulate(fixes_per_trip: DataFrame, route: Route, speed_mps: float = 14.0) -> DataFrame:
    """Fixes of one a second along the route for rows (trip_id, seconds)."""
    each = fixes_per_trip.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("seconds").cast("int"))))
    return each.withColumn("_p", point_at_distance(F.col("t") * speed_mps, route)).select("trip_id", "t", "_p.lng", "_p.lat")


def throttled(events: DataFrame, key: str, min_s: float, min_m: float) -> DataFrame:
    """Events (key, ts_ms, along_m) that fire: the first of a key, and then each at least min_s and min_m after the last
    that fired."""
    own, gap = events.select(key, "ts_ms", "along_m"), min_s * 1000
    return greedy.counting(own, key, ["ts_ms", "along_m"], F.floor(F.col("ts_ms") / (gap * greedy.FAN)), gap, *(("along_m", min_m) if min_m > 0 else ()))


def failure_probes(failures: DataFrame, key: str, most: int = 3, within_s: float = 30.0, tie: str | None = None) -> DataFrame:
    """(key, ts_ms) at which a probe starts: the `most`-th failure within within_s; the list then begins anew, and an event
    with ok set clears it. `tie` orders events of one time.

    A failure is due if the most - 1 failures before it came after the last success and within the time; of the due ones
    each first that is `most` failures past the last probe counts."""
    order = ["ts_ms", *([tie] if tie else [])]
    w = Window.partitionBy(key).orderBy(*order)
    # Successes so far, by which failures of one stretch are told from others; failures are numbered among themselves.
    rows = failures.select(key, *order, "ok").withColumn("_run", F.coalesce(F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).where("not ok")
    rows = rows.withColumn("_f", F.row_number().over(w)).withColumn("_first", F.lag(F.struct("ts_ms", "_run"), most - 1).over(w))
    due = rows.where((F.col("_first._run") == F.col("_run")) & (F.col("ts_ms") - F.col("_first.ts_ms") < within_s * 1000)).select(key, F.col("_f").alias("f"), "ts_ms")
    return greedy.counting(due, key, ["f"], F.floor(F.col("f") / (most * greedy.FAN)), most).select(key, "ts_ms")
