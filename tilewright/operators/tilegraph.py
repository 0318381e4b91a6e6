"""Road graphs from vector tiles: features to segments, names, dead ends, stitching, edges.

A segment is a stretch of road between two neighbouring vertices, in whole steps of the grid
of 1 / QUANT degrees: (seg, tile, ax, ay, bx, by, cls, oneway, ramp, level, name, length_m,
seconds). It stands for one or two directed edges by its oneway, so that splitting a segment
splits both directions alike. A vertex's packed id is its node.

Sizes of decoded tiles are guessed from the bytes they come from and so far too low: joins with
segments and vertices of names are told to merge, or all of them would be broadcast by way of the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions import geo, lookups, tiles
from tilewright.operators.graph import QUANT

ROAD_LAYERS = ["transportation", "road"]
NAME_LAYER = "transportation_name"
#: A name counts for an edge up to so many metres from it; the cells in which it is sought, degrees.
NAME_M, NAME_CELL = 15.0, 0.001
#: Vertices nearer than this are one node.
MERGE_M = 2.5
#: Where dead ends look for roads: cells in degrees, the least distance in metres, and how near a segment's end a joint may be.
STITCH_CELL, STITCH_MIN_M, STITCH_ENDS = 0.002, 0.5, 0.02
CONNECTOR_KMH = 30.0
SEGMENT = ["seg", "tile", "ax", "ay", "bx", "by", "cls", "oneway", "ramp", "level", "name", "length_m", "seconds"]


def degrees(v: Column) -> Column:
    return v / F.lit(float(QUANT))


def steps(v: Column) -> Column:
    """A coordinate in steps of the grid, halves up."""
    return F.floor(v * QUANT + 0.5).cast("long")


def node(x: Column, y: Column) -> Column:
    return (x + (1 << 23)) * (1 << 23) + (y + (1 << 22))


def length_m(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return geo.haversine_m(degrees(ax), degrees(ay), degrees(bx), degrees(by))


def _prop(key: str) -> Column:
    return F.try_element_at(F.col("props"), F.lit(key))


def _said(key: str) -> Column:
    """A property as text, whatever its type."""
    v = _prop(key)
    return F.coalesce(v["s"], v["b"].cast("string"), v["i"].cast("string"), v["d"].cast("string"))


def picked_layer(features: DataFrame, names: list[str] = ROAD_LAYERS) -> DataFrame:
    """The features of the first layer of each tile that has one of the names."""
    named = features.where(F.col("layer").isin(names))
    return named.withColumn("_first", F.min("layer_pos").over(Window.partitionBy("tile"))).where(F.col("layer_pos") == F.col("_first")).drop("_first")


def snapped(features: DataFrame, y_down: bool = False) -> DataFrame:
    """features with a row for each part of a path, points being its vertices in steps, none twice in a row.

    A tile's sides are worked out once a feature, not for each vertex."""
    _, z, x, y = tiles.parse_tile_key(F.col("tile"))

    def vertex(p: Column) -> Column:
        lng, lat = tiles.box_to_lnglat(p["x"].cast("double"), p["y"].cast("double"), F.col("_box"), F.col("extent"), y_down)
        return F.struct(steps(lng).alias("x"), steps(lat).alias("y"))

    rows = features.withColumn("_box", tiles.tile_box(x, y, z)).select("*", F.posexplode("paths").alias("part", "_path")).withColumn("_v", F.transform("_path", vertex))
    points = F.filter("_v", lambda v, i: (i == 0) | (v != F.get("_v", i - 1)))
    return rows.withColumn("points", points).drop("_path", "_v", "_box")


def segments(features: DataFrame, y_down: bool = False) -> DataFrame:
    """Segments of the roads of tile features; lines of one vertex, and without a class, are none."""
    cls = F.coalesce(_said("class"), _said("kind"))
    roads = picked_layer(features).where((F.col("type") == 2) & (F.coalesce(cls, F.lit("")) != ""))
    roads = roads.withColumn("cls", F.when(cls == "minor", "residential").otherwise(cls)).withColumn("oneway", lookups.parse_oneway(_said("oneway")))
    roads = roads.withColumn("ramp", _said("ramp").isin("1", "1.0", "true") & _said("ramp").isNotNull()).withColumn("level", F.coalesce(_prop("layer")["d"], F.lit(0.0)))
    roads = roads.withColumn("name", F.when(_prop("name")["s"] != "", _prop("name")["s"]))
    n = F.greatest(F.size("points") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("points", 1, n), F.slice("points", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = snapped(roads, y_down).select("*", F.posexplode(pairs).alias("i", "p"))
    rows = rows.select(F.concat_ws("|", "tile", F.lpad("pos", 6, "0"), "part", "i").alias("seg"), "tile", F.col("p.a.x").alias("ax"), F.col("p.a.y").alias("ay"), F.col("p.b.x").alias("bx"), F.col("p.b.y").alias("by"), "cls", "oneway", F.coalesce("ramp", F.lit(False)).alias("ramp"), "level", "name")
    rows = rows.withColumn("length_m", length_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return rows.withColumn("seconds", lookups.edge_weight(F.col("length_m"), F.col("cls"), F.col("ramp"), F.lit(False))).select(*SEGMENT)


#: Degrees from the equator up to which no two columns of the grid are nearer than MERGE_M.
MERGE_FROM = 42.0


def merged(segs: DataFrame) -> DataFrame:
    """segs with both ends at the nodes that merged_vertices() gives them, measured anew; what has shrunk to a point goes.

    Near the equator vertices are their own nodes: those segments stay as they are and meet no join."""
    far = lambda y: F.abs(degrees(F.col(y))) > MERGE_FROM
    segs = segs.withColumn("_far", far("ay") | far("by"))
    rows = segs.where("_far").drop("_far")
    ends = rows.select(F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")).select("p.*")
    moved = merged_vertices(ends).where("x <> node_x")
    for x, y in (("ax", "ay"), ("bx", "by")):
        to = moved.select(F.col("x").alias(x), F.col("y").alias(y), F.col("node_x").alias("_to"))
        rows = rows.join(to, [x, y], "left").withColumn(x, F.coalesce("_to", x)).drop("_to")
    rows = rows.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))).withColumn("length_m", length_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    rows = rows.withColumn("seconds", lookups.edge_weight(F.col("length_m"), F.col("cls"), F.col("ramp"), F.lit(False)))
    return segs.where("not _far").select(*SEGMENT).unionByName(rows.select(*SEGMENT))


def name_vertices(features: DataFrame, y_down: bool = False) -> DataFrame:
    """(tile, x, y, ord, name) of the vertices of the name layer, ord telling which came first."""
    named = features.where((F.col("layer") == NAME_LAYER) & (F.coalesce(_prop("name")["s"], F.lit("")) != "")).withColumn("name", _prop("name")["s"])
    every = snapped(named, y_down).select("tile", "name", "pos", "part", F.posexplode("points").alias("i", "p"))
    return every.select("tile", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.struct("pos", "part", "i").alias("ord"), "name")


def with_names(segs: DataFrame, names: DataFrame) -> DataFrame:
    """Segments without a name get that of the name layer of their tile: from the vertex that is theirs, else from the
    nearest within NAME_M, tried at the segment's beginning, middle and end in turn."""
    mid = lambda a, b: (degrees(F.col(a)) + degrees(F.col(b))) / 2
    at = F.array(*[F.struct(F.lit(k).alias("k"), lng.alias("lng"), lat.alias("lat")) for k, lng, lat in ((0, degrees(F.col("ax")), degrees(F.col("ay"))), (1, mid("ax", "bx"), mid("ay", "by")), (2, degrees(F.col("bx")), degrees(F.col("by"))))])
    asked = segs.where("name is null").select("seg", "tile", F.inline(at)).withColumn("x", steps(F.col("lng"))).withColumn("y", steps(F.col("lat")))
    exact = names.groupBy("tile", "x", "y").agg(F.min_by("name", "ord").alias("exact"))
    asked = asked.join(exact.hint("merge"), ["tile", "x", "y"], "left")
    cell = lambda v: F.floor(v / NAME_CELL)
    spread = F.array(F.lit(-1), F.lit(0), F.lit(1))
    far = asked.where("exact is null").select("seg", "tile", "k", "lng", "lat", F.explode(F.transform(spread, lambda d: cell(F.col("lng")) + d)).alias("cx"), F.transform(spread, lambda d: cell(F.col("lat")) + d).alias("cys"))
    far = far.select("seg", "tile", "k", "lng", "lat", "cx", F.explode("cys").alias("cy"))
    spots = names.select("tile", degrees(F.col("x")).alias("nx"), degrees(F.col("y")).alias("ny"), "ord", F.col("name").alias("found"))
    spots = spots.withColumn("cx", cell(F.col("nx"))).withColumn("cy", cell(F.col("ny")))
    m = F.hypot((F.col("ny") - F.col("lat")) * geo.DEGREE_M, (F.col("nx") - F.col("lng")) * geo.DEGREE_M * F.cos(F.radians("lat")))
    near = far.join(spots.hint("merge"), ["tile", "cx", "cy"]).withColumn("m", m).where(F.col("m") < NAME_M).groupBy("seg", "k").agg(F.min_by("found", F.struct("m", "ord")).alias("n"))
    found = asked.where("exact is not null").select("seg", "k", F.col("exact").alias("n")).unionByName(near).groupBy("seg").agg(F.min_by("n", "k").alias("_name"))
    return segs.join(found.hint("merge"), "seg", "left").withColumn("name", F.coalesce("name", "_name")).select(*SEGMENT)


def name_counts(features: DataFrame, segs: DataFrame, named: DataFrame) -> DataFrame:
    """(tile, names): named road features of a tile and segments that its name layer named."""
    own = picked_layer(features).where((F.col("type") == 2) & (F.coalesce(_said("class"), _said("kind"), F.lit("")) != "") & (F.coalesce(_prop("name")["s"], F.lit("")) != ""))
    joined = named.where("name is not null").join(segs.where("name is null").select("seg").hint("merge"), "seg", "left_semi")
    return own.select("tile").unionByName(joined.select("tile")).groupBy("tile").agg(F.count("*").alias("names"))


def edges(segs: DataFrame) -> DataFrame:
    """(seg, src, dst, cls, ramp, level, name, length_m, seconds): each direction in which a segment may be driven."""
    a, b = node(F.col("ax"), F.col("ay")), node(F.col("bx"), F.col("by"))
    there, back = F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst"))
    ways = F.when(F.col("oneway") == 1, F.array(there)).when(F.col("oneway") == -1, F.array(back)).otherwise(F.array(there, back))
    return segs.withColumn("_e", F.explode(ways)).select("seg", "_e.src", "_e.dst", "cls", "ramp", "level", "name", "length_m", "seconds")


def merged_vertices(points: DataFrame) -> DataFrame:
    """(x, y, node_x) for distinct vertices (x, y) in steps: the vertex's node is the western one of those nearer than
    MERGE_M, found or made from west to east. Rows of the grid are 3.4 m apart, so only vertices of one row can meet, and
    only so far from the equator that columns are nearer than that."""
    reach = F.floor(F.lit(MERGE_M * QUANT / geo.DEGREE_M) / F.cos(F.radians(degrees(F.col("y"))))).cast("long")
    w = Window.partitionBy("y").orderBy("x")
    rows = points.select("x", "y").distinct().withColumn("reach", reach).withColumn("new", F.coalesce((F.col("x") - F.lag("x").over(w) > F.col("reach")).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("y", "run", "reach").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    state = F.struct(F.lit(None).cast("bigint").alias("at"), F.array().cast("array<struct<x:bigint,node_x:bigint>>").alias("out"))

    def place(acc: Column, x: Column) -> Column:
        at = F.when(acc["at"].isNull() | (x - acc["at"] > F.col("reach")), x).otherwise(acc["at"])
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("x"), at.alias("node_x")))).alias("out"))

    return runs.select("y", F.inline(F.aggregate("xs", state, place, lambda acc: acc["out"]))).select("x", "y", "node_x")


def dead_ends(segs: DataFrame) -> DataFrame:
    """(node, x, y, segs, cls, ox, oy) of the nodes with one edge out and one in: their segments, and of the edge out
    its class and where it leads."""
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    forth, back = F.col("oneway") >= 0, F.col("oneway") <= 0
    ends = F.array(F.struct(a.alias("p"), b.alias("q"), forth.alias("out"), back.alias("in")), F.struct(b.alias("p"), a.alias("q"), back.alias("out"), forth.alias("in")))
    each = segs.select("seg", "cls", F.inline(ends))
    one = each.groupBy(F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(
        F.count_if("out").alias("n_out"), F.count_if("in").alias("n_in"), F.collect_set("seg").alias("segs"), F.max(F.when(F.col("out"), F.struct("cls", "q"))).alias("o")
    )
    return one.where("n_out = 1 and n_in = 1").select(node(F.col("x"), F.col("y")).alias("node"), "x", "y", "segs", F.col("o.cls").alias("cls"), F.col("o.q.x").alias("ox"), F.col("o.q.y").alias("oy"))


def joints(segs: DataFrame, max_m: float) -> DataFrame:
    """(node, x, y, cls, seg, m, t, jx, jy): for each dead end the nearest segment of others, STITCH_MIN_M to max_m away
    and not pointing away from it, and the vertex at which it joins. Segments lie in the cell of their middle."""
    ends = dead_ends(segs).select("node", "x", "y", "segs", F.col("cls").alias("own"), degrees(F.col("x")).alias("lng"), degrees(F.col("y")).alias("lat"), "ox", "oy")
    bearing = geo.bearing_deg(F.col("lng"), F.col("lat"), degrees(F.col("ox")), degrees(F.col("oy")))
    cell = lambda v: F.floor(v / STITCH_CELL)
    spread = F.array(F.lit(-1), F.lit(0), F.lit(1))
    ends = ends.withColumn("bearing", bearing).withColumn("cx", F.explode(F.transform(spread, lambda d: cell(F.col("lng")) + d))).withColumn("cy", F.explode(F.transform(spread, lambda d: cell(F.col("lat")) + d)))
    rows = segs.select("seg", "oneway", *[degrees(F.col(c)).alias(f"_{c}") for c in ("ax", "ay", "bx", "by")], "ax", "ay", "bx", "by")
    rows = rows.withColumn("cx", cell((F.col("_ax") + F.col("_bx")) / 2)).withColumn("cy", cell((F.col("_ay") + F.col("_by")) / 2))
    both = ends.join(rows.hint("merge"), ["cx", "cy"]).where(~F.array_contains("segs", F.col("seg")))
    k = F.cos(F.radians("lat"))
    dx, dy = (F.col("_bx") - F.col("_ax")) * k, F.col("_by") - F.col("_ay")
    t = ((F.col("lng") - F.col("_ax")) * k * dx + (F.col("lat") - F.col("_ay")) * dy) / (dx * dx + dy * dy)
    both = both.withColumn("m", geo.point_segment_m(F.col("lng"), F.col("lat"), F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by"))).withColumn("t", F.greatest(F.lit(STITCH_ENDS), F.least(F.lit(1 - STITCH_ENDS), t)))
    turn = F.abs(geo.angle_diff(F.col("bearing"), geo.bearing_deg(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by"))))
    ahead = lambda angle: (angle > 75) & (angle < 105) | (angle <= (150 if max_m > 60 else 105))
    fits = F.when(F.col("oneway") == 1, ahead(turn)).when(F.col("oneway") == -1, ahead(180 - turn)).otherwise(ahead(turn) | ahead(180 - turn))
    near = both.where(F.col("m").between(STITCH_MIN_M, max_m) & fits)
    best = near.groupBy("node").agg(F.min_by(F.struct("x", "y", "own", "seg", "m", "t", "_ax", "_ay", "_bx", "_by", "ax", "ay", "bx", "by"), F.struct("m", "seg")).alias("b")).select("node", "b.*")
    along = lambda a, b: steps(F.col(a) + F.col("t") * (F.col(b) - F.col(a)))
    best = best.withColumn("jx", along("_ax", "_bx")).withColumn("jy", along("_ay", "_by"))
    apart = lambda x, y: (F.col("jx") != F.col(x)) | (F.col("jy") != F.col(y))
    return best.where(apart("ax", "ay") & apart("bx", "by") & apart("x", "y")).select("node", "x", "y", F.col("own").alias("cls"), "seg", "m", "t", "jx", "jy")


def split(segs: DataFrame, joined: DataFrame) -> DataFrame:
    """Segments with those that dead ends join cut at all their joints, and a connector from each dead end to its joint.

    Pieces share their segment's seconds by length. All joints are found on the segments as they were, and a segment's
    are cut in the order in which they lie on it."""
    places = joined.groupBy("seg", "jx", "jy").agg(F.min("t").alias("t")).groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("t", "jx", "jy"))).alias("js"))
    cut = segs.join(places, "seg")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    stops = F.concat(F.array(point(F.col("ax"), F.col("ay"))), F.transform("js", lambda j: point(j["jx"], j["jy"])), F.array(point(F.col("bx"), F.col("by"))))
    cut = cut.withColumn("stops", stops)
    piece = lambda i: F.struct(F.get("stops", i).alias("a"), F.get("stops", i + 1).alias("b"))
    cut = cut.withColumn("ps", F.transform(F.sequence(F.lit(0), F.size("js")), piece))
    cut = cut.withColumn("ms", F.transform("ps", lambda p: length_m(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"])))
    cut = cut.withColumn("sum", F.aggregate("ms", F.lit(0.0), lambda a, m: a + m))
    pieces = cut.select("*", F.posexplode(F.arrays_zip("ps", "ms")).alias("i", "z")).select(
        F.concat_ws("|", "seg", F.concat(F.lit("p"), F.col("i"))).alias("seg"), "tile", F.col("z.ps.a.x").alias("ax"), F.col("z.ps.a.y").alias("ay"), F.col("z.ps.b.x").alias("bx"), F.col("z.ps.b.y").alias("by"),
        "cls", "oneway", "ramp", "level", "name", F.col("z.ms").alias("length_m"), (F.col("seconds") * F.col("z.ms") / F.col("sum")).alias("seconds"),
    )
    own = joined.join(segs.select("seg", "tile", "level", "name"), "seg").withColumn("length_m", length_m(F.col("x"), F.col("y"), F.col("jx"), F.col("jy"))).where(F.col("length_m") > STITCH_MIN_M)
    connectors = own.select(
        F.concat_ws("|", "seg", F.concat(F.lit("c"), F.col("node"))).alias("seg"), "tile", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("jx").alias("bx"), F.col("jy").alias("by"),
        "cls", F.lit(0).alias("oneway"), F.lit(False).alias("ramp"), "level", "name", "length_m", (F.col("length_m") / 1000 / CONNECTOR_KMH * 3600).alias("seconds"),
    )
    return segs.join(places, "seg", "left_anti").unionByName(pieces).unionByName(connectors)


def stitched(segs: DataFrame, max_m: float) -> DataFrame:
    """split() at the joints() of dead ends within max_m, as the zoom of the tiles has it (lookups.stitch_radius).

    Segments and joints are read several times and so written to the checkpoint folder first."""
    segs = segs.checkpoint()
    return split(segs, joints(segs, max_m).checkpoint())


def graph(tile_rows: DataFrame, stitch_m: float | None = None, y_down: bool = False) -> DataFrame:
    """Directed edges of the roads of tiles (k, data): decoded, snapped, near vertices merged, named, and stitched if
    stitch_m is given. Segments are read several times and so written to the checkpoint folder."""
    from tilewright.sources import mvt

    features = mvt.features(tile_rows, layers=[*ROAD_LAYERS, NAME_LAYER])
    segs = with_names(merged(segments(features, y_down).checkpoint()), name_vertices(features, y_down))
    return edges(stitched(segs, stitch_m) if stitch_m else segs)
