"""Inputs of the spatial queries, derived from the star-schema tables: one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXES = """select event_id, user_id as trip_id, ts,
  cast(-77.0 as double) + (event_id % 1000)/cast(1000.0 as double) as lng,
  cast(40.0 as double) + cast(0.28 as double)*((event_id % 1000)/cast(1000.0 as double))
    + ((event_id*37) % 21 - 10)*cast(0.00005 as double) as lat,
  cast(5 as double) + (event_id % 8)*4 as accuracy
from events"""

#: A day's fixes of a trip are a route: (route_id, ts, event_id, lng, lat).
TRIPS = f"select event_id, trip_id*100 + day(ts) as route_id, ts, lng, lat from ({FIXES}) own"

TILES = """select o_orderkey as tile_id,
  concat('planet/13/', cast(2343 + o_custkey % 24 as varchar(10)), '/', cast(3092 + o_orderkey % 10 as varchar(10))) as k,
  cast(13 as int) as z, cast(2343 + o_custkey % 24 as int) as x, cast(3092 + o_orderkey % 10 as int) as y,
  cast(floor(o_totalprice) as bigint) as size,
  case when o_orderpriority = '1-URGENT' then 'permanent' else 'smart' end as tier,
  o_orderdate as last_access,
  case when o_orderstatus = 'O' then 'route-1' end as pinned_by
from orders"""

WAYS = """select p_partkey as f, p_partkey+1 as t,
  case p_size%4 when 0 then 'motorway' when 1 then 'secondary' when 2 then 'residential' else 'service' end as cls,
  case p_size%7 when 0 then 1 when 1 then -1 else 0 end as oneway, p_name as nm
from part where p_partkey%40 < 39 and p_partkey+1 <= (select max(p_partkey) from part)
union all
select p_partkey, p_partkey+40, 'residential', 0, p_name
from part where p_partkey+40 <= (select max(p_partkey) from part)"""

PLACES = """select concat('n', cast(n_nationkey as varchar(10))) as id, n_name as name, 'city' as kind, 120 as boost,
  cast(-77.0 as double) + n_nationkey/cast(25.0 as double) as lng, cast(40.0 as double) as lat from nation
union all
select concat('p', cast(p_partkey as varchar(10))), p_name, 'street', 25,
  cast(-77.0 as double) + (p_partkey%40)/cast(40.0 as double), cast(40.0 as double) + (p_partkey%29)/cast(100.0 as double) from part
union all
select concat('s', cast(s_suppkey as varchar(10))), s_name, 'poi', 12,
  cast(-76.5 as double), cast(40.1 as double) + (s_suppkey%10)/cast(100.0 as double) from supplier"""

#: Features of road tiles of zoom 13, twenty parts to a tile: streets from edge to edge (each tile's a little off its
#: neighbour's, so that they end beside each other), every fifth part a street across them; ways that aren't roads; names
#: in a layer of their own, on the streets or beside them. Points are (x1, y1) to (x4, y4), in 4096 steps a tile.
_PARTS = """select p_partkey as id, p_name, p_size, p_partkey % 20 as j, cast(floor(p_partkey / cast(20 as double)) as bigint) as q from part"""
_LINES = f"""select id, p_name, p_size, j, q, cast(2344 + q % 20 as int) as x, cast(3098 - floor(q / cast(20 as double)) as int) as y,
  case when j % 5 < 4 then -24 else 2000 end as x1, 100 + 200 * (case when j % 5 < 4 then j else j - 4 end) + 6 * (q % 3) as y1,
  case when j % 5 = 4 or id % 7 = 3 then 2000 else 60 + (id * 37) % 300 end as x2, 100 + 200 * (case when j % 5 < 4 then j else j - 3 end) + 6 * (q % 3) as y2,
  2000 as x3, 100 + 200 * (case when j % 5 < 4 then j else j - 2 end) + 6 * (q % 3) as y3,
  case when j % 5 < 4 then 4120 else 2000 end as x4, 100 + 200 * (case when j % 5 < 4 then j else j - 1 end) + 6 * (q % 3) as y4
from ({_PARTS}) parts"""
_POINTS = "cast(x1 as int) as x1, cast(y1 + {d} as int) as y1, cast(x2 as int) as x2, cast(y2 + {d} as int) as y2, cast(x3 as int) as x3, cast(y3 + {d} as int) as y3, cast(x4 as int) as x4, cast(y4 + {d} as int) as y4"
FEATURES = f"""select concat('planet/13/', cast(x as varchar(10)), '/', cast(y as varchar(10))) as k, cast(13 as int) as z, x, y,
  case when id % 19 = 0 then 'road' else 'transportation' end as layer, cast(case when (id % 19 = 0) = (q % 10 = 9) then 1 else 2 end as int) as layer_pos,
  cast(j as int) as pos, id, cast(case when id % 23 = 5 then 1 else 2 end as int) as type,
  case when p_size % 13 = 12 or p_size % 9 = 0 then null when p_size % 4 = 0 then 'motorway' when p_size % 4 = 1 then 'secondary' when p_size % 4 = 2 then 'residential' else 'service' end as cls,
  case when p_size % 9 = 0 then 'minor' end as kind, cast(case when p_size % 7 = 0 then 1 end as bigint) as oneway, case when p_size % 7 = 1 then '-1' when p_size % 7 = 2 then 'yes' end as oneway_said,
  cast(case when p_size % 11 = 0 then 1 end as bigint) as ramp, case when id % 3 = 0 then p_name end as name, {_POINTS.format(d=0)} from ({_LINES}) ls
union all
select concat('planet/13/', cast(x as varchar(10)), '/', cast(y as varchar(10))), cast(13 as int), x, y, 'transportation_name', cast(3 as int), cast(j as int), id, cast(2 as int), null, null, cast(null as bigint), null, cast(null as bigint),
  concat('Old ', p_name), {_POINTS.format(d='(case when id % 3 = 1 then 0 when id % 2 = 0 then 8 else 60 end)')} from ({_LINES}) ls where id % 3 > 0 and j % 5 < 4
union all
select concat('planet/13/', cast(x as varchar(10)), '/', cast(y as varchar(10))), cast(13 as int), x, y, 'water', cast(0 as int), cast(j as int), id, cast(3 as int), 'lake', null, cast(null as bigint), null, cast(null as bigint), null, {_POINTS.format(d=0)} from ({_LINES}) ls where j = 7"""

#: The same features 15 degrees further north, where columns of the grid are nearer than vertices may be: some vertices are
#: one or two columns off.
NORTH = f"""select concat('planet/13/', cast(x as varchar(10)), '/', cast(y - 507 as varchar(10))) as k, z, x, cast(y - 507 as int) as y, layer, layer_pos, pos, id, type, cls, kind, oneway, oneway_said, ramp, name,
  x1, y1, cast(x2 + id % 2 * 3 as int) as x2, y2, cast(x3 + id % 3 * 3 as int) as x3, y3, x4, y4 from ({FEATURES}) fs"""

#: Features of tiles of zooms 11 to 14 that search reads: places, street names and points of interest, some without names.
LABELS = f"""select concat('planet/', cast(11 + q % 4 as varchar(10)), '/', cast(1000 + q as varchar(10)), '/700') as k, cast(11 + q % 4 as int) as z,
  case j % 4 when 0 then 'place' when 1 then 'transportation_name' when 2 then 'transportation' else 'poi' end as layer, cast(j % 4 as int) as layer_pos, cast(j as int) as pos, id, cast(case j % 4 when 0 then 1 when 3 then 1 else 2 end as int) as type,
  case p_size % 5 when 0 then 'city' when 1 then 'town' when 2 then 'suburb' when 3 then 'isolated' end as cls, case when p_size % 10 = 9 then '' else p_name end as name from ({_PARTS}) parts"""

_FROM = {"features": (FEATURES, ["part"]), "north": (NORTH, ["part"]), "labels_of_tiles": (LABELS, ["part"]), "fixes": (FIXES, ["events"]), "trips": (TRIPS, ["events"]), "tiles": (TILES, ["orders"]), "ways": (WAYS, ["part"]), "places": (PLACES, ["nation", "part", "supplier"])}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """fixes, trips, tiles, ways, places, features, north or labels_of_tiles over the tables of sf_dir."""
    text, tables = _FROM[name]
    return spark.sql(
        "with " + ", ".join(f"{t} as (select * from {{{t}}})" for t in tables) + " " + text,
        **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables},
    )


def with_derived(sql: str) -> str:
    """The oracle's text: the derived inputs it names as common table expressions before it."""
    ctes = [f"{n} as ({_FROM[n][0]})" for n in _FROM if re.search(rf"\b{n}\b", sql)]
    return f"with {', '.join(ctes)} {sql}" if ctes else sql
