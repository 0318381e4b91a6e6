"""Queries of geometry, tiles, lookups and texts, row by row over the derived inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.derive import derived, with_derived
from tilewright.functions import formatting as fmt
from tilewright.functions import geo, lookups, tiles

QUERIES: dict = {}
ORACLE_SQL: dict = {}
A = (-76.4, 40.1)
C = F.col


def register(name: str, source: str, build, sql: str | None = None) -> None:
    """build(df) -> DataFrame over a derived input; sql is its equivalent over the CTE of that name."""
    QUERIES[name] = lambda spark, sf_dir: build(derived(spark, sf_dir, source))
    if sql:
        ORACLE_SQL[name] = with_derived(sql)


def hav(a, b, c, d) -> str:
    return f"(2*{geo.R}*asin(least(1.0, sqrt(pow(sin(radians(({d})-({b}))/2),2)+cos(radians({b}))*cos(radians({d}))*pow(sin(radians(({c})-({a}))/2),2)))))"


def brg(a, b, c, d) -> str:
    y = f"sin(radians(({c})-({a})))*cos(radians({d}))"
    x = f"cos(radians({b}))*sin(radians({d}))-sin(radians({b}))*cos(radians({d}))*cos(radians(({c})-({a})))"
    return f"((degrees(atan2({y},{x}))+360)::double - 360*floor((degrees(atan2({y},{x}))+360)/360))"


def tx(lng, z) -> str:
    return f"cast(floor((({lng})+180)/360*pow(2,{z})) as int)"


def ty(lat, z) -> str:
    p = f"radians(greatest(-85.05112878, least(85.05112878, {lat})))"
    return f"cast(floor((1-ln(tan({p})+1/cos({p}))/pi())/2*pow(2,{z})) as int)"


def west(x, z) -> str:
    return f"(({x})/pow(2,{z})*360-180)"


def north(y, z) -> str:
    e = f"(pi()*(1-2*({y})/pow(2,{z})))"
    return f"degrees(atan((exp({e})-exp(-{e}))/2))"


def rounded(*cols) -> list:
    return [F.round(c, n).alias(name) for name, c, n in cols]


def case(table: dict, key: str, default) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"case {key} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in table.items()) + f" else {q(default) if default is not None else 'null'} end"


L = lambda: (F.lit(A[0]), F.lit(A[1]))
register("geo1_haversine", "fixes", lambda d: d.select("event_id", *rounded(("m", geo.haversine_m(C("lng"), C("lat"), *L()), 3))), f"select event_id, round({hav('lng', 'lat', *A)},3) as m from fixes")
register("geo2_bearing", "fixes", lambda d: d.select("event_id", *rounded(("deg", geo.bearing_deg(C("lng"), C("lat"), *L()), 4))), f"select event_id, round({brg('lng', 'lat', *A)},4) as deg from fixes")
register(
    "geo3_angle_diff", "fixes",
    lambda d: d.select("event_id", geo.angle_diff(C("event_id") * 7.0 % 360, C("event_id") * 13.0 % 360).alias("d")),
    "select event_id, case when d0 = -180 then 180 else d0 end as d from (select event_id, (b-a+540) - 360*floor((b-a+540)/360) - 180 as d0 from (select event_id, cast(event_id*7 % 360 as double) as a, cast(event_id*13 % 360 as double) as b from fixes))",
)


def _destination(d):
    lng, lat = geo.destination(C("lng"), C("lat"), C("event_id") % 360, C("accuracy") * 100)
    return d.select("event_id", *rounded(("lng", lng, 7), ("lat", lat, 7)))


_DD, _DB = f"(accuracy*100/{geo.R})", "radians(event_id % 360)"
_DQ = f"asin(sin(radians(lat))*cos({_DD})+cos(radians(lat))*sin({_DD})*cos({_DB}))"
register("geo4_destination", "fixes", _destination, f"select event_id, round(degrees(radians(lng)+atan2(sin({_DB})*sin({_DD})*cos(radians(lat)), cos({_DD})-sin(radians(lat))*sin({_DQ}))),7) as lng, round(degrees({_DQ}),7) as lat from fixes")
register("geo5_to_xy", "fixes", lambda d: d.select("event_id", *rounded(*[(n, c, 3) for n, c in zip(("x", "y"), geo.to_xy(C("lng"), C("lat"), *L()), strict=True)])), f"select event_id, round(radians(lng-({A[0]}))*{geo.R}*cos(radians({A[1]})),3) as x, round(radians(lat-({A[1]}))*{geo.R},3) as y from fixes")


def seg_sql(k: str, ax, ay, bx, by) -> str:
    """(t, dist) by plain factor k metres a degree, as a subselect's columns over lng, lat."""
    dx, dy = f"((({bx})-({ax}))*cos(radians(lat))*{k})", f"((({by})-({ay}))*{k})"
    px, py = f"((lng-({ax}))*cos(radians(lat))*{k})", f"((lat-({ay}))*{k})"
    t = f"(case when {dx}*{dx}+{dy}*{dy} > 0 then least(1.0, greatest(0.0, ({px}*{dx}+{py}*{dy})/({dx}*{dx}+{dy}*{dy}))) else 0.0 end)"
    return t, f"sqrt(pow({px}-{t}*{dx},2)+pow({py}-{t}*{dy},2))"


_S7 = (-77.0, 40.0, -76.0, 40.28)
register("geo7_point_segment", "fixes", lambda d: d.select("event_id", *rounded(("m", geo.point_segment_m(C("lng"), C("lat"), *map(F.lit, _S7)), 3))), f"select event_id, round({seg_sql('111320.0', *_S7)[1]},3) as m from fixes")
register("geo15_planar", "fixes", lambda d: d.select("event_id", *rounded(("m", geo.planar_m(C("lng"), C("lat"), *L()), 3))), f"select event_id, round(sqrt(pow(radians(({A[0]})-lng)*cos(radians(lat)),2)+pow(radians({A[1]}-lat),2))*{geo.R},3) as m from fixes")


def _pad(d):
    box = geo.pad_bbox(C("lng"), C("lat"), C("lng") + 0.1, C("lat") + 0.2, C("accuracy") * 10)
    return d.select("event_id", *rounded(*[(n, c, 8) for n, c in zip(("min_lng", "min_lat", "max_lng", "max_lat"), box, strict=True)]))


_PL = f"degrees(accuracy*10/{geo.R})"
_PG = f"({_PL}/greatest(0.05, cos(radians((lat+lat+0.2)/2))))"
register("geo11_pad_bbox", "fixes", _pad, f"select event_id, round(lng-{_PG},8) as min_lng, round(lat-{_PL},8) as min_lat, round(lng+0.1+{_PG},8) as max_lng, round(lat+0.2+{_PL},8) as max_lat from fixes")
_BOX = (-76.8, 40.1, -76.6, 40.15)
register(
    "geo12_segment_bbox", "fixes",
    lambda d: d.select("event_id", *rounded(("m", geo.segment_bbox_m(C("lng"), C("lat"), C("lng") + 0.01, C("lat") + 0.01, tuple(map(F.lit, _BOX))), 2))),
    f"select event_id, round(sqrt(pow(radians(dlat)*{geo.R},2)+pow(radians(dlng)*{geo.R}*cos(radians(mid)),2)),2) as m from (select event_id, greatest({_BOX[1]}-(lat+0.01), lat-{_BOX[3]}, 0.0) as dlat, greatest({_BOX[0]}-(lng+0.01), lng-({_BOX[2]}), 0.0) as dlng, (greatest({_BOX[1]}, lat)+least({_BOX[3]}, lat+0.01))/2 as mid from fixes)",
)


def _circle(d):
    p = d.select("event_id", F.posexplode(geo.circle(C("lng"), C("lat"), C("accuracy"))).alias("i", "p"))
    return p.select("event_id", C("i").cast("long").alias("i"), *rounded(("lng", C("p.lng"), 8), ("lat", C("p.lat"), 8)))


register("geo17_circle_whole", "fixes", _circle)
register(
    "geo17_circle", "fixes",
    _circle,
    "select event_id, i, round(lng + least(accuracy,300)/(111320*greatest(0.1,cos(radians(lat))))*cos(radians((i%24)*15)),8) as lng, round(lat + least(accuracy,300)/111320*sin(radians((i%24)*15)),8) as lat from fixes, range(25) r(i)",
)

# Tiles
_Z = "cast(10 + event_id % 5 as int)"
Z = lambda: (10 + C("event_id") % 5).cast("int")
register("til1_tile_key", "tiles", lambda d: d.select("tile_id", *[c.alias(n) for n, c in zip(("source", "z", "x", "y"), tiles.parse_tile_key(C("k")), strict=True)], tiles.tile_key(F.lit("planet"), C("z"), C("x"), C("y")).alias("k")), "select tile_id, split_part(k,'/',1) as source, cast(split_part(k,'/',2) as int) as z, cast(split_part(k,'/',3) as int) as x, cast(split_part(k,'/',4) as int) as y, concat('planet/', z, '/', x, '/', y) as k from tiles")
register("til2_lnglat_to_tile", "fixes", lambda d: d.select("event_id", Z().alias("z"), tiles.tile_x(C("lng"), Z()).alias("x"), tiles.tile_y(C("lat"), Z()).alias("y")), f"select event_id, {_Z} as z, {tx('lng', _Z)} as x, {ty('lat', _Z)} as y from fixes")
register("til3_tile_bounds", "tiles", lambda d: d.select("tile_id", *rounded(("w", tiles.tile_west(C("x"), C("z")), 9), ("e", tiles.tile_west(C("x") + 1, C("z")), 9), ("n", tiles.tile_north(C("y"), C("z")), 9), ("s", tiles.tile_north(C("y") + 1, C("z")), 9))), f"select tile_id, round({west('x', 'z')},9) as w, round({west('x+1', 'z')},9) as e, round({north('y', 'z')},9) as n, round({north('y+1', 'z')},9) as s from tiles")
register("til4_tile_center", "tiles", lambda d: d.select("tile_id", *rounded(*[(n, c, 9) for n, c in zip(("lng", "lat"), tiles.tile_center(C("x"), C("y"), C("z")), strict=True)])), f"select tile_id, round(({west('x', 'z')}+{west('x+1', 'z')})/2,9) as lng, round(({north('y', 'z')}+{north('y+1', 'z')})/2,9) as lat from tiles")
register("til5_tile_width", "fixes", lambda d: d.select("event_id", *rounded(("m", tiles.tile_width_m(Z(), C("lat")), 3))), f"select event_id, round(40075016.7*cos(radians(lat))/pow(2,{_Z}),3) as m from fixes")


def _in_bbox(d):
    box = tiles.tiles_in_bbox(C("lng") - 0.05, C("lat") - 0.05, C("lng") + 0.05, C("lat") + 0.05, F.lit(13))
    return d.select("event_id", F.explode(box).alias("t")).select("event_id", "t.x", "t.y")


register("til6_tiles_in_bbox_whole", "fixes", _in_bbox)
register(
    "til6_tiles_in_bbox", "fixes",
    _in_bbox,
    f"select event_id, cast(x as int) as x, cast(y as int) as y from (select event_id, unnest(range({tx('lng-0.05', 13)}, {tx('lng+0.05', 13)}+1)) as x, lat from fixes), lateral (select unnest(range({ty('lat+0.05', 13)}, {ty('lat-0.05', 13)}+1)) as y)",
)
register("til7_metres_per_pixel", "fixes", lambda d: d.select("event_id", *rounded(("m", tiles.metres_per_pixel(Z(), C("lat")), 6))), f"select event_id, round(156543.03392*cos(radians(lat))/pow(2,{_Z}),6) as m from fixes")
register(
    "til8_stored_in_bbox", "tiles",
    lambda d: d.where((tiles.tile_west(C("x"), C("z")) <= -76.7) & (tiles.tile_west(C("x") + 1, C("z")) >= -76.9) & (tiles.tile_north(C("y") + 1, C("z")) <= 40.5) & (tiles.tile_north(C("y"), C("z")) >= 40.3)).select("tile_id", "k"),
    f"select tile_id, k from tiles where {west('x', 'z')} <= -76.7 and {west('x+1', 'z')} >= -76.9 and {north('y+1', 'z')} <= 40.5 and {north('y', 'z')} >= 40.3",
)
register(
    "til9_local_to_lnglat", "tiles",
    lambda d: d.select("tile_id", *rounded(*[(n, c, 9) for n, c in zip(("lng", "lat"), tiles.local_to_lnglat(C("tile_id") % 4096, C("size") % 4096, C("x"), C("y"), C("z"), F.lit(4096.0)), strict=True)])),
    f"select tile_id, round({west('x', 'z')} + (tile_id%4096)/4096.0*({west('x+1', 'z')}-{west('x', 'z')}),9) as lng, round({north('y+1', 'z')} + (size%4096)/4096.0*({north('y', 'z')}-{north('y+1', 'z')}),9) as lat from tiles",
)
register("src10_tile_url", "tiles", lambda d: d.select("tile_id", tiles.fill_url(F.lit("https://t/{z}/{x}/{y}.pbf"), C("z"), C("x"), C("y")).alias("url")), "select tile_id, concat('https://t/', z, '/', x, '/', y, '.pbf') as url from tiles")

# Lookups
register("fil3_parse_oneway", "ways", lambda d: d.select("f", "t", lookups.parse_oneway(F.when(C("f") % 3 == 0, "yes").otherwise(C("oneway").cast("string"))).alias("oneway")), "select f, t, case when f%3=0 then 1 else oneway end as oneway from ways")
register("fil4_accessible", "ways", lambda d: d.select("f", "t", lookups.is_accessible(C("cls"), "bicycle").alias("ok")), "select f, t, cls in ('secondary','residential','service') as ok from ways")
register("fil5_drivable", "ways", lambda d: d.where(lookups.is_accessible(C("cls"), "car")).select("f", "t"), "select f, t from ways where cls in ('motorway','secondary','residential','service')")
register("fil6_class_speed", "ways", lambda d: d.select("f", "t", lookups.class_speed(C("cls")).alias("kmh")), f"select f, t, {case(lookups.CLASS_SPEED, 'cls', 30)} as kmh from ways")
register(
    "fil7_edge_weight", "ways",
    lambda d: d.select("f", "t", *rounded(("s", lookups.edge_weight(100.0 + C("f") % 50, C("cls"), C("f") % 5 == 0, C("f") % 7 == 0), 6))),
    f"select f, t, round((100.0+f%50)::double/1000/{case(lookups.CLASS_SPEED, 'cls', 30)}*3600*(case when f%5=0 then 1.1 else 1 end)::double*(case when f%7=0 then 1.2 else 1 end)::double,6) as s from ways",
)
register("fil8_mode_weight", "ways", lambda d: d.select("f", "t", *rounded(("s", lookups.mode_weight(100.0 + C("f") % 50, C("cls"), "car"), 6))), f"select f, t, round((100.0+f%50)::double/1000/least(50, {case(lookups.CLASS_SPEED, 'cls', 30)})*3600,6) as s from ways")
register("fil9_live_edges", "ways", lambda d: d.where((C("oneway") >= 0) & lookups.is_accessible(C("cls"), "bicycle")).select("f", "t"), "select f, t from ways where oneway >= 0 and cls in ('secondary','residential','service')")
register("fil10_class_rank", "ways", lambda d: d.select("f", "t", lookups.class_rank(C("cls")).alias("rank")), f"select f, t, {case(lookups.CLASS_RANK, 'cls', 0)} as rank from ways")
register("fil13_theme", "fixes", lambda d: d.select("event_id", lookups.theme(F.hour("ts")).alias("theme")), "select event_id, case when hour(ts) >= 7 and hour(ts) < 19 then 'day' else 'night' end as theme from fixes")
register("fil14_stitch_radius", "fixes", lambda d: d.select("event_id", lookups.stitch_radius(8 + C("event_id") % 8).alias("m")), "select event_id, case when 8+event_id%8 >= 14 then 15 when 8+event_id%8 = 13 then 80 when 8+event_id%8 = 12 then 200 when 8+event_id%8 = 11 then 400 when 8+event_id%8 = 10 then 800 else 1200 end as m from fixes")
_DELTA = lambda: F.pmod(C("event_id") * 37.0, F.lit(360.0)) - 179.5
register("grf15_modifier", "fixes", lambda d: d.select("event_id", lookups.modifier_for(_DELTA()).alias("modifier")), "select event_id, case when abs(d)>=160 then 'uturn' when abs(d)>=120 then case when d>0 then 'sharp right' else 'sharp left' end when abs(d)>=45 then case when d>0 then 'right' else 'left' end when abs(d)>=20 then case when d>0 then 'slight right' else 'slight left' end else 'straight' end as modifier from (select event_id, event_id*37%360 - 179.5 as d from fixes)")

# Texts
_M = lambda: C("event_id") * 13 + 3
register("fmt1_distance", "fixes", lambda d: d.select("event_id", fmt.distance(_M().cast("double")).alias("t")), "select event_id, case when m<950 then concat(cast(floor(m/10+0.5)*10 as bigint),' m') when m/1000<10 then concat(cast(floor(floor(m/100+0.5)/10) as bigint),'.',cast(floor(m/100+0.5) as bigint)%10,' km') else concat(cast(floor(m/1000+0.5) as bigint),' km') end as t from (select event_id, cast(event_id*13+3 as double) as m from fixes)")
register("fmt2_duration", "fixes", lambda d: d.select("event_id", fmt.duration(_M()).alias("t")), "select event_id, case when n<1 then '<1 min' when n<60 then concat(n,' min') when n%60=0 then concat(n//60,' h') else concat(n//60,' h ',n%60,' min') end as t from (select event_id, cast(floor((event_id*13+3)/60.0+0.5) as bigint) as n from fixes)")
register("fmt3_eta", "fixes", lambda d: d.select("event_id", fmt.eta(C("ts"), C("event_id") % 5000).alias("t")), "select event_id, strftime(ts + to_seconds(event_id % 5000), '%H:%M') as t from fixes")
register("fmt4_speed", "fixes", lambda d: d.select("event_id", fmt.speed(F.when(C("event_id") % 10 > 0, C("event_id") % 50 + 0.3)).alias("t")), "select event_id, case when event_id%10=0 then '—' else concat(cast(floor((event_id%50+0.3)*3.6+0.5) as bigint),' km/h') end as t from fixes")
register("fmt5_bytes", "tiles", lambda d: d.select("tile_id", fmt.size(C("size") % 900).alias("a"), fmt.size(C("size")).alias("b")), "select tile_id, concat(size%900,' B') as a, case when size<1024 then concat(size,' B') else concat(cast(floor(size/1024.0+0.5) as bigint),' KB') end as b from tiles")
_KIND = lambda: F.element_at(F.array(*[F.lit(k) for k in ("depart", "merge", "roundabout", "continue", "arrive", "turn")]), (C("f") % 6 + 1).cast("int"))
_MOD = lambda: F.when(C("f") % 4 == 0, "left").when(C("f") % 4 == 1, "uturn")
_NAME = lambda: F.when(C("f") % 5 > 0, C("nm")).otherwise("")
register(
    "fmt6_instruction", "ways",
    lambda d: d.select("f", "t", fmt.instruction(_KIND(), _MOD(), _NAME()).alias("shown"), fmt.instruction(_KIND(), _MOD(), _NAME(), spoken=True).alias("spoken")),
    "select f, t, case f%6 when 0 then concat('Head out', case when n<>'' then concat(' on ',n) else '' end) when 1 then concat('Merge',onto) when 2 then concat('Enter the roundabout', case when n<>'' then concat(', exit onto ',n) else '' end) when 3 then concat('Continue', case when n<>'' then concat(' on ',n) else '' end) when 4 then 'Arrive at your destination' else turn end as shown, case f%6 when 0 then case when n<>'' then concat('Continue on ',n) else 'Begin the route' end when 1 then concat('Merge',onto) when 2 then case when n<>'' then concat('At the roundabout, take the exit onto ',n) else 'Enter the roundabout' end when 3 then concat('Continue', case when n<>'' then concat(' on ',n) else '' end) when 4 then 'You have arrived' else turn end as spoken from (select *, case f%4 when 0 then concat('Turn left',onto) when 1 then concat('Make a U-turn',onto) else concat('Continue straight',onto) end as turn from (select *, case when n<>'' then concat(' onto ',n) else '' end as onto from (select f, t, case when f%5>0 then nm else '' end as n from ways)))",
)
register("fmt7_arrow", "fixes", lambda d: d.select("event_id", fmt.arrow_rotation(lookups.modifier_for(_DELTA())).alias("deg")), "select event_id, case when abs(d)>=160 then 160 when abs(d)>=120 then case when d>0 then 110 else -110 end when abs(d)>=45 then case when d>0 then 85 else -85 end when abs(d)>=20 then case when d>0 then 35 else -35 end else 0 end as deg from (select event_id, event_id*37%360 - 179.5 as d from fixes)")
register("fmt8_road_name", "ways", lambda d: d.select("f", "t", fmt.road_name(_NAME(), C("cls")).alias("name")), f"select f, t, case when f%5>0 then nm else {case(lookups.CLASS_PHRASE, 'cls', 'the road')} end as name from ways")
