"""Queries of the tile store and its cache policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.derive import derived, with_derived
from tilewright.functions import tiles
from tilewright.operators import routes, store
from tilewright.plans import sqls
from tilewright.plans.routes import ROUTE, plan_tiles
from tilewright.plans.scalars import hav, north, tx, ty, west

QUERIES: dict = {}
ORACLE_SQL: dict = {}
C = F.col
BUDGET = 100_000_000


def register(name, build, sql=None, source="tiles") -> None:
    QUERIES[name] = lambda spark, sf_dir: build(derived(spark, sf_dir, source))
    if sql:
        ORACLE_SQL[name] = with_derived(sql)


SMART = lambda: C("tier") == "smart"
register("agg1_usage", store.usage, "select tier, cast(sum(size) as bigint) as bytes, count(*) as tiles from tiles group by tier")
register("agg2_pressure", lambda d: store.pressure(d, BUDGET), f"select cast(used as bigint) as used, case when used > {BUDGET} then 'critical' when used > 0.85*{BUDGET} then 'high' else 'ok' end as pressure from (select coalesce(sum(size) filter (where tier='smart'),0) as used from tiles)")
register("agg3_freed", lambda d: d.where(SMART()).agg(F.sum("size").alias("bytes")), "select cast(sum(size) as bigint) as bytes from tiles where tier = 'smart'")
register("snk9_clear_smart", lambda d: d.where(SMART()).agg(F.sum("size").alias("freed"), F.count("*").alias("tiles")), "select cast(sum(size) as bigint) as freed, count(*) as tiles from tiles where tier = 'smart'")
register("agg10_distinct_tiles", lambda d: d.select("z", "x", "y").dropDuplicates(), "select distinct z, x, y from tiles")
register("snk1_upsert", store.latest, "select k, arg_max(size, (last_access, tile_id)) as size, arg_max(tier, (last_access, tile_id)) as tier, max(last_access) as last_access from tiles group by k")
_KEYS = lambda d: d.where(C("x") % 2 == 0).select("k").distinct()
register("snk2_delete", lambda d: d.join(_KEYS(d), "k", "left_anti").select("tile_id", "k"), "select tile_id, k from tiles where x % 2 <> 0")
register("jon10_delete_by_keys", lambda d: d.join(_KEYS(d), "k", "left_semi").select("tile_id", "k"), "select tile_id, k from tiles where k in (select k from tiles where x%2=0)")
register("jon13_wanted_minus_loaded", lambda d: _KEYS(d).join(d.where("y % 3 = 0").select("k"), "k", "left_anti"), "select distinct k from tiles where x%2=0 and k not in (select k from tiles where y%3=0)")
register("snk3_pin", lambda d: store.pin(d, _KEYS(d), "route-2"), "select tile_id, case when tier='smart' and x%2=0 then 'route-2' else pinned_by end as pinned_by from tiles")
register("snk3_unpin", lambda d: store.unpin(d, "route-1"), "select tile_id, case when pinned_by='route-1' then null else pinned_by end as pinned_by from tiles")
register("snk4_list_areas", lambda d: store.areas(d).select("id", F.size("tile_keys").alias("n"), "bytes"), "select concat('area-', x) as id, cast(count(distinct k) as int) as n, cast(sum(size) as bigint) as bytes from tiles group by x")
register("snk5_delete_area", lambda d: store.delete_area(d, store.areas(d), "area-2350").select("tile_id"), "select tile_id from tiles where x <> 2350")
register("snk7_touch", lambda d: d.groupBy("k").agg(F.max("last_access").alias("last_access")), "select k, max(last_access) as last_access from tiles group by k")
register("src7_cache_first", lambda d: store.cache_first(_KEYS(d), d), "select k, max(size) as size, max(size) > 0 as hit from tiles where x%2=0 group by k")
register("src9_bulk_read", lambda d: d.join(_KEYS(d), "k", "left_semi").groupBy("k").count(), "select k, count(*) as count from tiles where x%2=0 group by k")
register("srt5_lru_order", lambda d: d.where(SMART()).orderBy("last_access", "tile_id").select("tile_id"), "select tile_id from tiles where tier='smart' order by last_access, tile_id")
QUERIES["srt5_lru_order_whole"] = QUERIES["srt5_lru_order"]
_EVICT = "(select *, coalesce(sum(size) over (order by last_access, tile_id rows between unbounded preceding and 1 preceding),0) as before, {used} as used from tiles where tier='smart'{where})"
_USED = "(select sum(size) from tiles where tier='smart')"
register("win7_eviction_prefix", lambda d: store.evict(d, BUDGET).select("tile_id"), f"select tile_id from {_EVICT.format(used=_USED, where='')} where used > floor(0.9*{BUDGET}) and used - before > floor(0.9*{BUDGET})")
register("str10_cache_trim", lambda d: store.trim(d, 1500, 1300), "select tile_id from (select tile_id, row_number() over (order by last_access desc, tile_id desc) as n, count(*) over () as c from tiles) where c <= 1500 or n <= 1300")


def _settings(spark, sf_dir):
    """Defaults, what each customer saved, and the preset of their country."""
    said = [(0, "units", F.lit("metric")), (0, "theme", F.lit("auto")), (1, "theme", F.when(C("c_custkey") % 3 == 0, "night")), (1, "budget", (C("c_custkey") % 5 * 100).cast("string")), (2, "units", F.when(C("c_nationkey") % 4 == 0, "imperial")), (2, "budget", F.when(C("c_nationkey") % 7 == 0, "900"))]
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.inline(F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(n).alias("name"), v.alias("value")) for i, n, v in said])))
    return store.settings(rows, "c_custkey")


QUERIES["snk8_settings"] = _settings
ORACLE_SQL["snk8_settings"] = "select c_custkey, 'units' as name, case when c_nationkey%4=0 then 'imperial' else 'metric' end as value from customer union all select c_custkey, 'theme', case when c_custkey%3=0 then 'night' else 'auto' end from customer union all select c_custkey, 'budget', case when c_nationkey%7=0 then '900' else cast(c_custkey%5*100 as varchar) end from customer"

# Protection along the route: pinned, its centre in the corridor, and not far behind the position.
ALONG, CORRIDOR_M, BEHIND_M = 50_000.0, 2000.0, 5000.0
PROTECTED = lambda d: store.protected(d, ROUTE, ALONG, CORRIDOR_M, BEHIND_M)
_CENTERS = f"(select *, ({west('x', 13)}+{west('x+1', 13)})/2 as lng, ({north('y', 13)}+{north('y+1', 13)})/2 as lat from tiles)"
_PROTECTED = f"(select tile_id from {sqls.projected(_CENTERS, 'tile_id', ROUTE)} where pinned_by is not null and dist_m <= {CORRIDOR_M} and along_m >= {ALONG - BEHIND_M})"
register("jon8_protected", lambda d: PROTECTED(d).where("protected").select("tile_id"), f"select tile_id from {_PROTECTED}")
register(
    "cor4_plan_eviction",
    lambda d: store.evict(PROTECTED(d), BUDGET, C("protected")).select("tile_id", "k", "size"),
    f"select tile_id, k, size from {_EVICT.format(used=_USED, where=f' and tile_id not in {_PROTECTED}')} where used > floor(0.9*{BUDGET}) and used - before > floor(0.9*{BUDGET})",
)
QUERIES["cor4_plan_eviction_whole"] = QUERIES["cor4_plan_eviction"]
register("grf11_prune_radius", lambda d: d.where(store.center_distance(-76.9, 40.2) <= 20000).select("tile_id"), f"select tile_id from {_CENTERS} where {hav('lng', 'lat', '-76.9', '40.2')} <= 20000")
_ZOOMED = lambda d: d.withColumn("s", C("tile_id") % 3).select("tile_id", (13 - C("s")).cast("int").alias("z"), F.floor(C("x") / F.pow(F.lit(2.0), C("s"))).cast("int").alias("x"), F.floor(C("y") / F.pow(F.lit(2.0), C("s"))).cast("int").alias("y"))
_ZOOMED_SQL = f"(select *, ({west('x', 'z')}+{west('x+1', 'z')})/2 as lng, ({north('y', 'z')}+{north('y+1', 'z')})/2 as lat from (select tile_id, cast(13 - tile_id%3 as int) as z, cast(floor(x/pow(2,tile_id%3)) as int) as x, cast(floor(y/pow(2,tile_id%3)) as int) as y from tiles))"
register("grf12_drop_coarse", lambda d: store.without_coarse(_ZOOMED(d), ROUTE, 12, 10_000.0).select("tile_id", "z"), f"select tile_id, z from {sqls.projected(_ZOOMED_SQL, 'tile_id', ROUTE)} where z > 12 or dist_m <= 10000")

# What comes in: some tiles are stored, some of those asked for come empty, some don't come.
_STORED = lambda d: store.latest(d.where("x % 2 = 0")).select("k", "size", "tier")
_ARRIVED = lambda d: d.where("x % 3 = 0").select("k", F.when(C("y") % 5 == 0, F.lit(None)).when(C("y") % 4 == 0, 0).otherwise(C("y").cast("long") * 1000).alias("size")).distinct()
register(
    "src8_fetch_and_store",
    lambda d: store.fetched(_STORED(d), _ARRIVED(d)),
    "select k, coalesce(n.size, o.size) as size, case when n.size is not null then 'smart' else o.tier end as tier from (select k, arg_max(size, (last_access, tile_id)) as size, arg_max(tier, (last_access, tile_id)) as tier from tiles where x%2=0 group by k) o full join (select distinct k, cast(y as bigint)*1000 as size from tiles where x%3=0 and y%5<>0 and y%4<>0) n using (k)",
)
register("agg14_prefetch_stats", lambda d: store.fetch_stats(_ARRIVED(d)), "select count(*) filter (where size > 0) as stored, count(*) filter (where size is null or size = 0) as failed, cast(sum(size) as bigint) as bytes from (select distinct k, case when y%5=0 then null when y%4=0 then 0 else cast(y as bigint)*1000 end as size from tiles where x%3=0)")
QUERIES["src8_non_empty"] = lambda spark, sf_dir: _ARRIVED(derived(spark, sf_dir, "tiles")).where("size > 0")
ORACLE_SQL["src8_non_empty"] = with_derived("select distinct k, cast(y as bigint)*1000 as size from tiles where x%3=0 and y%5<>0 and y%4<>0")
QUERIES["agg9_min_zoom"] = lambda spark, sf_dir: store.min_zoom(spark.range(7).select(C("id").alias("g")), derived(spark, sf_dir, "labels_of_tiles").where("id % 7 < 5 and pos < 3 * (id % 7)").select((C("id") % 7).alias("g"), "z"), "g")
ORACLE_SQL["agg9_min_zoom"] = with_derived("select g, cast(coalesce(min(z), 99) as int) as z from range(7) r(g) left join (select id%7 as g, z from labels_of_tiles where id%7 < 5 and pos < 3*(id%7)) using (g) group by g")

# Trips from each fix: near, far, and round the world.
_TRIP_LNG, _TRIP_LAT = "(lng + case when event_id%101=7 then 150 when event_id%97=5 then 40 else (event_id%37)*0.1 end)", "(lat - case when event_id%101=7 then 75 when event_id%97=5 then 10 else (event_id%13)*0.2 end)"


def _trips(d):
    far = lambda a, b, c: F.when(C("event_id") % 101 == 7, a).when(C("event_id") % 97 == 5, b).otherwise(c)
    t = d.withColumn("t", store.coarse_zoom(C("lng"), C("lat"), C("lng") + far(150.0, 40.0, C("event_id") % 37 * 0.1), C("lat") - far(75.0, 10.0, C("event_id") % 13 * 0.2)))
    return t.select("event_id", "t.z", "t.tiles", "t.ok")


def _n_tiles_sql(w, s, e, n, z) -> str:
    return f"(cast({tx(e, z)} - {tx(w, z)} + 1 as bigint) * greatest(0, least({ty(s, z)}, pow(2,{z})-1) - greatest({ty(n, z)}, 0) + 1))"


_PAD = f"degrees(greatest(3000.0, direct*0.08)/{store.geo.R})"
_WIDE = "greatest(0.05, cos(radians((least(lat,v)+greatest(lat,v))/2)))"
register(
    "fil15_coarse_zoom",
    _trips,
    f"select event_id, z, tiles, tiles <= {store.COARSE_CAP * 3} as ok from (select event_id, max(z) as z, arg_max(tiles, z) as tiles from (select event_id, cast(z as int) as z, start, cast({_n_tiles_sql('x0', 'y0', 'x1', 'y1', 'z')} as bigint) as tiles from (select *, least(lng,u)-{_PAD}/{_WIDE} as x0, greatest(lng,u)+{_PAD}/{_WIDE} as x1, least(lat,v)-{_PAD} as y0, greatest(lat,v)+{_PAD} as y1, case when direct > 150000 then 11 when direct > 40000 then 12 else 13 end as start from (select *, {hav('lng', 'lat', 'u', 'v')} as direct from (select event_id, lng, lat, {_TRIP_LNG} as u, {_TRIP_LAT} as v from fixes))), range({store.COARSE_LEAST}, 14) zs(z)) where z <= start and (tiles <= {store.COARSE_CAP} or z = {store.COARSE_LEAST}) group by event_id)",
    "fixes",
)

# Areas for download, from small to too large.
_AREAS = "(select n_nationkey as id, -77.0 + n_nationkey*0.02 as west, 40.0 - n_nationkey*0.01 as south, -77.0 + n_nationkey*0.02 + 0.1*(n_nationkey+1) as east, 40.0 + 0.05*(n_nationkey+1) as north, cast(10 + n_nationkey%5 as int) as max_zoom from nation)"


def _areas(spark, sf_dir):
    n = C("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("id"), (-77.0 + n * 0.02).alias("west"), (40.0 - n * 0.01).alias("south"), (-77.0 + n * 0.02 + 0.1 * (n + 1)).alias("east"), (40.0 + 0.05 * (n + 1)).alias("north"), (10 + n % 5).cast("int").alias("max_zoom"))


_GUARD = f"(select id, west, south, east, north, max_zoom, sum(case when z <= max_zoom then {_n_tiles_sql('west', 'south', 'east', 'north', 'z')} else 0 end) as n from {_AREAS}, range(4, 15) zs(z) group by all)"
QUERIES["fil16_area_guard"] = lambda spark, sf_dir: store.area_guard(_areas(spark, sf_dir)).select("id", "n", "ok")
ORACLE_SQL["fil16_area_guard"] = f"select id, cast(n as bigint) as n, n <= {store.AREA_MOST} as ok from {_GUARD}"
QUERIES["cor7_area_download"] = lambda spark, sf_dir: store.area_download(_areas(spark, sf_dir), derived(spark, sf_dir, "tiles").where("tile_id % 5 > 0"))
_EACH = f"(select id, z, x, unnest(range(greatest({ty('north', 'z')}, 0), least({ty('south', 'z')}, cast(pow(2,z) as bigint)-1)+1)) as y from (select *, unnest(range({tx('west', 'z')}, {tx('east', 'z')}+1)) as x from {_GUARD}, range(4, 15) zs(z) where n <= {store.AREA_MOST} and z <= max_zoom))"
ORACLE_SQL["cor7_area_download"] = with_derived(
    f"select id, cast(z as int) as z, cast(x as int) as x, cast(y as int) as y, case when coalesce(size,0) <= 0 then 'fetch' when tier = 'smart' then 'upgrade' else 'keep' end as action from {_EACH} left join (select k, max(size) as size, arg_max(tier, size) as tier from tiles where tile_id%5 > 0 group by k) on k = concat('planet/', z, '/', x, '/', y)"
)
QUERIES["cor7_missing_keys"] = lambda spark, sf_dir: QUERIES["cor7_area_download"](spark, sf_dir).where("action = 'fetch' and z = 13").select("x", "y").distinct()
ORACLE_SQL["cor7_missing_keys"] = f"select distinct x, y from ({ORACLE_SQL['cor7_area_download']}) where action = 'fetch' and z = 13"


def _pins(spark, sf_dir):
    """Smart tiles that the route's corridor, detail and overview pin."""
    keys = plan_tiles(spark, sf_dir).select(tiles.tile_key(F.lit("planet"), C("z"), C("x"), C("y")).alias("k")).distinct()
    return store.pin(derived(spark, sf_dir, "tiles"), keys, "route-9").where("pinned_by = 'route-9'")


QUERIES["cor8_route_pins"] = _pins
ORACLE_SQL["cor8_route_pins"] = with_derived(f"select tile_id, 'route-9' as pinned_by from tiles where tier = 'smart' and (x, y) in (select (x, y) from {sqls.corridor(routes.segments(ROUTE), 13, 2000.0)})")
