"""Queries from vector tiles to road graphs. The inputs are encoded to tile bytes first, so that each query decodes them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tilewright.derive import FEATURES, NORTH, derived, with_derived
from tilewright.functions import geo, lookups
from tilewright.operators import planner, search, tilegraph
from tilewright.plans.graph import checkpointed
from tilewright.plans.scalars import brg, case, hav, north, west
from tilewright.sources import mvt

QUERIES: dict = {}
ORACLE_SQL: dict = {}
C = F.col
STITCH_M = 80.0


def _property(key: str, text=None, number=None):
    value = F.struct(text.alias("s") if text is not None else F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("boolean").alias("b"), number.alias("i") if number is not None else F.lit(None).cast("bigint").alias("i"))
    return F.when(text.isNotNull() if text is not None else number.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))


def _features(rows, props, points):
    """Feature rows as the encoder takes them."""
    known = F.map_from_entries(F.filter(F.array(*props), lambda p: p.isNotNull()))
    return rows.select(C("k").alias("tile"), "layer", "layer_pos", F.lit(4096).alias("extent"), "id", "type", known.alias("props"), F.array(F.array(*[F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in points])).alias("paths"), "pos")


def road_tiles(spark, sf_dir):
    """(k, data): the bytes of the derived road tiles."""
    return _encoded(derived(spark, sf_dir, "features"))


def _encoded(rows):
    props = [_property("class", C("cls")), _property("kind", C("kind")), _property("oneway", number=C("oneway")), _property("oneway", C("oneway_said")), _property("ramp", number=C("ramp")), _property("name", C("name"))]
    return mvt.encode(_features(rows, props, [(C(f"x{i}"), C(f"y{i}")) for i in range(1, 5)]))


def label_tiles(spark, sf_dir):
    """(k, data): the bytes of the derived tiles of places, names and points of interest."""
    rows = derived(spark, sf_dir, "labels_of_tiles")
    return mvt.encode(_features(rows, [_property("class", C("cls")), _property("name", C("name"))], [(C("pos") * 10, C("pos") * 20), (C("pos") * 10 + 5, C("pos") * 20)]))


def _read(spark, sf_dir):
    return mvt.features(road_tiles(spark, sf_dir))


def _segments(spark, sf_dir):
    return tilegraph.segments(_read(spark, sf_dir))


def _kept(rows):
    """rows that a plan reads several times: made once and written to the checkpoint folder."""
    checkpointed(rows.sparkSession)
    return rows.checkpoint()


def _named(spark, sf_dir):
    f = _kept(_read(spark, sf_dir))
    return tilegraph.with_names(tilegraph.segments(f), tilegraph.name_vertices(f))


def register(name, build, sql=None, more=None) -> None:
    """sql stands for itself, or with `more` (further common tables, or none) after the tables of vertices and segments."""
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = with_derived(sql) if more is None else f"with features as ({FEATURES}), {_LINES_SQL}{more} {sql}"


# Vertices in steps of the grid, then pairs of different neighbours.
_LNG, _LAT = f"({west('x', 'z')} + px/4096.0*({west('x+1', 'z')}-{west('x', 'z')}))", f"({north('y+1', 'z')} + py/4096.0*({north('y', 'z')}-{north('y+1', 'z')}))"
_LINES_SQL = f"""vertices as (select k, layer, layer_pos, pos, type, coalesce(case when kind = 'minor' then 'residential' end, cls) as cls, case when oneway = 1 or oneway_said = 'yes' then 1 when oneway_said = '-1' then -1 else 0 end as oneway, coalesce(ramp = 1, false) as ramp, name, i,
  cast(floor({_LNG}*32768+0.5) as bigint) as vx, cast(floor({_LAT}*32768+0.5) as bigint) as vy
  from (select f.*, i, case i when 1 then x1 when 2 then x2 when 3 then x3 else x4 end as px, case i when 1 then y1 when 2 then y2 when 3 then y3 else y4 end as py from features f, (values (1),(2),(3),(4)) p(i))),
picked as (select *, row_number() over (partition by k, layer, pos order by i) as n from (select *, lag(vx) over w as ox, lag(vy) over w as oy, min(case when layer in ('transportation','road') then layer_pos end) over (partition by k) as first_pos from vertices window w as (partition by k, layer, pos order by i)) where ox is null or ox <> vx or oy <> vy),
segs as (select concat_ws('|', k, lpad(cast(pos as varchar), 6, '0'), '0', cast(n - 1 as varchar)) as seg, k, pos, vx as ax, vy as ay, bx, by_, cls, oneway, ramp, name, {hav('vx/32768.0', 'vy/32768.0', 'bx/32768.0', 'by_/32768.0')} as m from (select *, lead(vx) over (partition by k, layer, pos order by n) as bx, lead(vy) over (partition by k, layer, pos order by n) as by_ from picked where layer in ('transportation','road') and layer_pos = first_pos and type = 2 and cls is not null) where bx is not null),
timed as (select *, m/1000/{case(lookups.CLASS_SPEED, 'cls', lookups.DEFAULT_SPEED)}*3600*(case when ramp then 1.1 else 1 end) as secs from segs)"""
_NODE = "((({x}) + 8388608)*8388608 + (({y}) + 4194304))"
r = lambda c, n=3: F.round(c, n)

register(
    "src1_read_tiles",
    lambda spark, sf_dir: _read(spark, sf_dir).select(C("tile").alias("k"), "layer", "layer_pos", "pos", "id", "type", C("props")["class"]["s"].alias("class"), C("props")["oneway"]["i"].alias("oneway"), F.size(C("paths")[0]).alias("n"), C("paths")[0][1]["y"].alias("y")),
    "select k, layer, layer_pos, pos, id, type, cls as class, oneway, n, y from (select k, layer, cast(dense_rank() over (partition by k order by layer_pos) - 1 as int) as layer_pos, cast(row_number() over (partition by k, layer order by pos) - 1 as int) as pos, id, type, cls, oneway, cast(4 as int) as n, y2 as y from features)",
)
register(
    "fil2_layer_pick",
    lambda spark, sf_dir: tilegraph.picked_layer(_read(spark, sf_dir)).groupBy(C("tile").alias("k")).agg(F.min("layer").alias("layer"), F.count("*").alias("features")),
    "select k, min(layer) as layer, count(*) as features from (select *, min(layer_pos) over (partition by k) as first_pos from features where layer in ('road', 'transportation')) where layer_pos = first_pos group by k",
)
register(
    "win3_consecutive_duplicates",
    lambda spark, sf_dir: tilegraph.snapped(_read(spark, sf_dir)).select(C("tile").alias("k"), "layer", "id", F.size("points").alias("n"), F.get("points", F.lit(1))["x"].alias("x"), F.get("points", F.lit(1))["y"].alias("y")),
    "select k, layer, id, cast(count(*) as int) as n, max(case when n = 2 then vx end) as x, max(case when n = 2 then vy end) as y from (select p.*, f.id from picked p join features f using (k, layer, pos)) group by k, layer, id",
    "",
)
_SEG_COLS = lambda d: d.select("seg", "ax", "ay", "bx", "by", "cls", "oneway", "ramp", "name", r(C("length_m")).alias("m"), r(C("seconds")).alias("s"))
register("grf5_segments", lambda spark, sf_dir: _SEG_COLS(_segments(spark, sf_dir)).drop("seg"), "select ax, ay, bx, by_ as by, cls, cast(oneway as int) as oneway, ramp, name, round(m,3) as m, round(secs,3) as s from timed", "")
register(
    "grf5_tile_graph",
    lambda spark, sf_dir: tilegraph.edges(_segments(spark, sf_dir)).select("src", "dst", "cls", r(C("length_m")).alias("m"), r(C("seconds")).alias("s")),
    f"select {_NODE.format(x='ax', y='ay')} as src, {_NODE.format(x='bx', y='by_')} as dst, cls, round(m,3) as m, round(secs,3) as s from timed where oneway >= 0 union all select {_NODE.format(x='bx', y='by_')}, {_NODE.format(x='ax', y='ay')}, cls, round(m,3), round(secs,3) from timed where oneway <= 0",
    "",
)
_SPOTS = "spots as (select k, vx, vy, pos*10+n as ord, name from picked where layer = 'transportation_name')"
_TRIES = "tries as (select seg, k, t, case t when 0 then ax when 1 then (ax+bx)/2.0 else bx end/32768.0 as lng, case t when 0 then ay when 1 then (ay+by_)/2.0 else by_ end/32768.0 as lat from timed, (values (0),(1),(2)) v(t) where name is null)"
_EXACT = "exact as (select seg, t, arg_min(s.name, s.ord) as name from tries u join spots s on s.k = u.k and s.vx = floor(u.lng*32768+0.5) and s.vy = floor(u.lat*32768+0.5) group by seg, t)"
_FAR = "sqrt(pow((s.vy/32768.0-u.lat)*111320.0,2) + pow((s.vx/32768.0-u.lng)*111320.0*cos(radians(u.lat)),2))"
_BESIDE = f"beside as (select seg, t, arg_min(name, (d, ord)) as name from (select u.seg, u.t, s.name, s.ord, {_FAR} as d from tries u join spots s on s.k = u.k and abs(floor((s.vx/32768.0)/0.001) - floor(u.lng/0.001)) <= 1 and abs(floor((s.vy/32768.0)/0.001) - floor(u.lat/0.001)) <= 1 where (u.seg, u.t) not in (select (seg, t) from exact)) where d < 15 group by seg, t)"
_FOUND = f", {_SPOTS}, {_TRIES}, {_EXACT}, {_BESIDE}, found as (select seg, arg_min(name, t) as name from (select * from exact union all select * from beside) group by seg)"
register("jon4_name_join", lambda spark, sf_dir: _SEG_COLS(_named(spark, sf_dir)).select("ax", "ay", "bx", "by", "cls", "name"), "select ax, ay, bx, by_ as by, cls, coalesce(t.name, f.name) as name from timed t left join found f using (seg)", _FOUND)



def _name_counts(f):
    segs = _kept(tilegraph.segments(f))
    return tilegraph.name_counts(f, segs, tilegraph.with_names(segs, tilegraph.name_vertices(f)))


register(
    "agg13_name_count",
    lambda spark, sf_dir: _name_counts(_kept(_read(spark, sf_dir))).select(C("tile").alias("k"), "names"),
    "select k, count(*) as names from (select k from timed join found using (seg) union all select k from (select distinct p.k, p.layer, p.pos from picked p where layer in ('transportation','road') and layer_pos = first_pos and type = 2 and cls is not null and name is not null)) group by k",
    _FOUND,
)

# Dead ends and what they join.
_ENDS = "ends as (select seg, cls, ax as x, ay as y, bx as qx, by_ as qy, oneway >= 0 as o, oneway <= 0 as i from timed union all select seg, cls, bx, by_, ax, ay, oneway <= 0, oneway >= 0 from timed), dead as (select x, y, list(distinct seg) as own_segs, max(case when o then cls end) as own, max(case when o then qx end) as qx, max(case when o then qy end) as qy from ends group by x, y having count_if(o) = 1 and count_if(i) = 1)"
_DEG = lambda *cs: [f"({c}/32768.0)" for c in cs]
_K = "cos(radians(d.y/32768.0))"
_DX, _DY, _PX, _PY = f"((s.bx-s.ax)/32768.0*{_K})", "((s.by_-s.ay)/32768.0)", f"((d.x-s.ax)/32768.0*{_K})", "((d.y-s.ay)/32768.0)"
_T0 = f"(({_PX}*{_DX}+{_PY}*{_DY})/({_DX}*{_DX}+{_DY}*{_DY}))"
_TC = f"least(1.0, greatest(0.0, {_T0}))"
_TURN = f"abs(case when dd = -180 then 180 else dd end)"
_JOINTS = f"""tried as (select d.x, d.y, d.own, s.seg, s.oneway, s.ax, s.ay, s.bx, s.by_, 111320.0*sqrt(pow({_PX}-{_TC}*{_DX},2) + pow({_PY}-{_TC}*{_DY},2)) as m, least(0.98, greatest(0.02, {_T0})) as t,
  ({brg(*_DEG('s.ax', 's.ay', 's.bx', 's.by_'))} - {brg(*_DEG('d.x', 'd.y', 'd.qx', 'd.qy'))} + 540) as turn from dead d join timed s on abs(floor((s.ax/32768.0+s.bx/32768.0)/2/0.002) - floor(d.x/32768.0/0.002)) <= 1 and abs(floor((s.ay/32768.0+s.by_/32768.0)/2/0.002) - floor(d.y/32768.0/0.002)) <= 1 where not list_contains(d.own_segs, s.seg)),
  turned as (select *, {_TURN} as al from (select *, turn - 360*floor(turn/360) - 180 as dd from tried) where m between 0.5 and {STITCH_M}),
  best as (select x, y, arg_min(own, (m, seg)) as own, arg_min(seg, (m, seg)) as seg, min(m) as m, arg_min(t, (m, seg)) as t, arg_min(ax, (m, seg)) as ax, arg_min(ay, (m, seg)) as ay, arg_min(bx, (m, seg)) as bx, arg_min(by_, (m, seg)) as by_ from turned where (oneway >= 0 and (al <= 150)) or (oneway <= 0 and (180 - al <= 150)) group by x, y),
  joins as (select * from (select *, cast(floor((ax/32768.0 + t*(bx-ax)/32768.0)*32768+0.5) as bigint) as jx, cast(floor((ay/32768.0 + t*(by_-ay)/32768.0)*32768+0.5) as bigint) as jy from best) where (jx, jy) <> (ax, ay) and (jx, jy) <> (bx, by_) and (jx, jy) <> (x, y))"""
register("grf6_dead_ends", lambda spark, sf_dir: tilegraph.dead_ends(_segments(spark, sf_dir)).select("node", "cls", F.size("segs").alias("n")), f"select {_NODE.format(x='x', y='y')} as node, own as cls, cast(len(own_segs) as int) as n from dead", f", {_ENDS}")
register("jon6_dead_end_join", lambda spark, sf_dir: tilegraph.joints(_kept(_segments(spark, sf_dir)), STITCH_M).select("node", "cls", r(C("m")).alias("m"), r(C("t"), 6).alias("t"), "jx", "jy"), f"select {_NODE.format(x='x', y='y')} as node, own as cls, round(m,3) as m, round(t,6) as t, jx, jy from joins", f", {_ENDS}, {_JOINTS}")
_STOPS = "stops as (select seg, t, jx as px, jy as py from (select seg, jx, jy, min(t) as t from joins group by seg, jx, jy) union all select seg, 0.0, ax, ay from timed where seg in (select seg from joins) union all select seg, 1.0, bx, by_ from timed where seg in (select seg from joins))"
_PIECES = f"pieces as (select seg, px, py, qx, qy, pm, sum(pm) over (partition by seg) as total from (select *, {hav('px/32768.0', 'py/32768.0', 'qx/32768.0', 'qy/32768.0')} as pm from (select *, lead(px) over w as qx, lead(py) over w as qy from stops window w as (partition by seg order by t, px, py)) where qx is not null))"
_JM = hav("x/32768.0", "y/32768.0", "jx/32768.0", "jy/32768.0")
_STITCHED = f", {_ENDS}, {_JOINTS}, {_STOPS}, {_PIECES}, stitched as (select ax, ay, bx, by_, cls, oneway, m, secs from timed where seg not in (select seg from joins) union all select px, py, qx, qy, t.cls, t.oneway, pm, t.secs*pm/total from pieces join timed t using (seg) union all select x, y, jx, jy, own, 0, {_JM}, {_JM}/1000/30*3600 from joins where {_JM} > 0.5)"


def _joined(spark, sf_dir):
    checkpointed(spark)
    return tilegraph.stitched(_segments(spark, sf_dir), STITCH_M)


register("grf7_stitched", lambda spark, sf_dir: _joined(spark, sf_dir).select("ax", "ay", "bx", "by", "cls", "oneway", r(C("length_m")).alias("m"), r(C("seconds")).alias("s")), "select ax, ay, bx, by_ as by, cls, cast(oneway as int) as oneway, round(m,3) as m, round(secs,3) as s from stitched", _STITCHED)

# Vertices of rows far north, near enough to meet.
_NORTH = "(select distinct cast(-2500000 + (p_partkey * 7) % 400 as bigint) as x, cast(1500000 + 20000 * (p_partkey % 29) as bigint) as y from part)"
_REACH = f"floor({tilegraph.MERGE_M}*32768/111320.0/cos(radians(y/32768.0)))"


def _merged(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    points = part.select((F.lit(-2_500_000) + C("p_partkey") * 7 % 400).cast("long").alias("x"), (F.lit(1_500_000) + 20_000 * (C("p_partkey") % 29)).cast("long").alias("y"))
    return tilegraph.merged_vertices(points)


QUERIES["jon2_proximity"] = _merged
ORACLE_SQL["jon2_proximity"] = f"with recursive pts as (select *, cast({_REACH} as bigint) as reach from {_NORTH}), walk(x, y, node_x) as (select min(x), y, min(x) from pts group by y union all select p.x, p.y, case when p.x - w.node_x > p.reach then p.x else w.node_x end from walk w join (select *, lag(x) over (partition by y order by x) as before from pts) p on p.y = w.y and p.before = w.x) select x, y, node_x from walk"

# The graph of tiles far north, with vertices merged.


def _north(spark, sf_dir):
    checkpointed(spark)
    segs = tilegraph.segments(mvt.features(_encoded(derived(spark, sf_dir, "north"))))
    return tilegraph.edges(tilegraph.merged(segs.checkpoint()))


_MOVED = f"pts as (select *, cast({_REACH} as bigint) as reach, lag(x) over (partition by y order by x) as before from (select ax as x, ay as y from segs union select bx, by_ from segs)), walk(x, y, node_x) as (select min(x), y, min(x) from pts group by y union all select p.x, p.y, case when p.x - w.node_x > p.reach then p.x else w.node_x end from walk w join pts p on p.y = w.y and p.before = w.x)"
_AT_NODES = f"laid as (select *, {hav('ax/32768.0', 'ay/32768.0', 'bx/32768.0', 'by_/32768.0')} as len from (select s.* exclude (ax, bx), a.node_x as ax, b.node_x as bx from segs s join walk a on a.x = s.ax and a.y = s.ay join walk b on b.x = s.bx and b.y = s.by_) where ax <> bx or ay <> by_), costed as (select *, len/1000/{case(lookups.CLASS_SPEED, 'cls', lookups.DEFAULT_SPEED)}*3600*(case when ramp then 1.1 else 1 end) as cost from laid)"
QUERIES["grf5_north_graph"] = lambda spark, sf_dir: _north(spark, sf_dir).select("src", "dst", "cls", r(C("length_m")).alias("m"), r(C("seconds")).alias("s"))
ORACLE_SQL["grf5_north_graph"] = f"with recursive features as ({NORTH}), {_LINES_SQL}, {_MOVED}, {_AT_NODES} select {_NODE.format(x='ax', y='ay')} as src, {_NODE.format(x='bx', y='by_')} as dst, cls, round(len,3) as m, round(cost,3) as s from costed where oneway >= 0 union all select {_NODE.format(x='bx', y='by_')}, {_NODE.format(x='ax', y='ay')}, cls, round(len,3), round(cost,3) from costed where oneway <= 0"

# Search documents of tiles
_DOCS = f"""(select concat(k, '|p|', name) as id, name, {case(lookups.PLACE_KIND, 'cls', 'hamlet')} as kind, cast({case(lookups.PLACE_BOOST, 'cls', 40)} as int) as boost, k from labels_of_tiles where layer = 'place' and name <> ''
 union all select concat(k, '|s|', name), name, 'street', 25, k from (select k, layer, arg_min(name, (id, name)) as name from labels_of_tiles where layer in ('transportation','transportation_name') and z >= 12 and name <> '' group by k, layer, lower(name))
 union all select concat(k, '|o|', name), name, 'poi', 12, k from labels_of_tiles where layer = 'poi' and z >= 14 and name <> '')"""
_EXTRACTED = lambda spark, sf_dir: search.extract(mvt.features(label_tiles(spark, sf_dir)))
register("sea1_extract_docs", lambda spark, sf_dir: _EXTRACTED(spark, sf_dir).select("id", "name", "kind", "boost"), f"select id, name, kind, boost from {_DOCS}")
register("agg11_street_dedup", lambda spark, sf_dir: _EXTRACTED(spark, sf_dir).where("kind = 'street'").groupBy("tile").agg(F.count("*").alias("streets"), F.countDistinct("norm").alias("names")).select(C("tile").alias("k"), "streets", "names"), f"select k, count(*) as streets, count(distinct lower(name)) as names from {_DOCS} where kind = 'street' group by k")
# Documents are put again with those of some tiles changed, then those of other tiles are removed.
_GONE = lambda: F.split("tile", "/")[2].cast("int") % 3 == 0


def _put_and_removed(spark, sf_dir):
    docs = _EXTRACTED(spark, sf_dir).select("id", "name", "boost", "tile")
    again = docs.where(C("boost") > 20).withColumn("boost", C("boost") + 1)
    return search.remove_docs(search.put_docs(docs, again), docs.where(_GONE()).select("tile")).select("id", "name", "boost")


register("snk6_put_docs", _put_and_removed, f"select id, min(name) as name, max(case when boost > 20 then boost + 1 else boost end) as boost from {_DOCS} where cast(split_part(k, '/', 3) as int) % 3 <> 0 group by id")


def _pyramid(spark, sf_dir):
    """(k, data): the streets, all to be driven both ways, in tiles of zoom 13 and in those of zoom 12 over them."""
    free = derived(spark, sf_dir, "features").where("layer_pos < 3 and type = 2 and layer <> 'water'").withColumn("layer", F.lit("transportation")).withColumn("layer_pos", F.lit(0))
    free = free.withColumns({"cls": F.lit("residential"), "kind": F.lit(None).cast("string"), "oneway": F.lit(None).cast("bigint"), "oneway_said": F.lit(None).cast("string")})
    rows = free.withColumn("k", F.concat(F.lit("planet/12/"), F.floor(C("x") / 2), F.lit("/"), F.floor(C("y") / 2))).withColumn("pos", F.pmod("x", F.lit(2)) * 40 + F.pmod("y", F.lit(2)) * 20 + C("pos"))
    for i in range(1, 5):
        rows = rows.withColumn(f"x{i}", (F.pmod("x", F.lit(2)) * 2048 + C(f"x{i}") / 2).cast("int")).withColumn(f"y{i}", ((1 - F.pmod("y", F.lit(2))) * 2048 + C(f"y{i}") / 2).cast("int"))
    return _encoded(free).unionByName(_encoded(rows))


def _in_tile(x: int, y: int) -> tuple[float, float]:
    """A place on the second street of a tile of zoom 13."""
    north_of = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / 8192))))
    return (x + 2000 / 4096) / 8192 * 360 - 180, north_of(y + 1) + 300 / 4096 * (north_of(y) - north_of(y + 1))


def _plans(spark, sf_dir):
    """Plans of a few trips: their zooms, points and reasons."""
    checkpointed(spark)
    stored = _pyramid(spark, sf_dir).checkpoint()
    here, near, far = _in_tile(2344, 3098), _in_tile(2347, 3098), _in_tile(2360, 3098)
    trips = [(0, here, near), (1, here, far), (2, here, (-70.0, 40.1)), (3, (10.0, 50.0), (10.01, 50.0)), (4, here, (60.0, -30.0))]
    rows = [(i, p.zoom, p.reason, len(p.points), p.fine) for i, a, b in trips for p in [planner.plan(stored, a, b)]]
    return spark.createDataFrame(rows, "id int, zoom int, reason string, n_points int, fine boolean")


QUERIES["grf20_two_phase_plan"] = _plans
