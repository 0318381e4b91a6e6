"""Queries of the tile decoder and of the stateful engine in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tilewright.derive import FIXES, TILES, derived, with_derived
from tilewright.functions import geo, lookups
from tilewright.operators import routes
from tilewright.plans.graph import checkpointed
from tilewright.plans.routes import PROJECTED, ROUTE, TOTAL, day_legs, folded_sql, points_sql
from tilewright.plans.scalars import brg
from tilewright.sources import gps
from tilewright.streaming import navigation, sinks

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def with_millis(fixes):
    return fixes.select("trip_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "lng", "lat", "accuracy")


def _engine(spark, sf_dir):
    checkpointed(spark)
    n = navigation.snapshots(with_millis(derived(spark, sf_dir, "fixes")), ROUTE)
    return n.withColumn("along_m", F.round("along_m", 3)).withColumn("dist_m", F.round("dist_m", 3))


QUERIES["str1_engine"] = _engine
QUERIES["win10_reroute"] = lambda spark, sf_dir: _engine(spark, sf_dir).where("reroute").select("trip_id", "event_id")
_WANTED = "(({c}) >= 2 or (r.off and r.dist_m > 4*r.lim)) and not r.here"
_COUNT = "case when r.off then w.off_count + 1 else greatest(0, w.off_count - 1) end"
_FIRST = "(off and dist_m > 4*lim and not here)"
_ROWS = f"select *, row_number() over (partition by trip_id order by ts_ms, event_id) as n from (select trip_id, event_id, epoch_us(ts)//1000 as ts_ms, dist_m, greatest(35.0, accuracy*1.8) as lim, dist_m > greatest(35.0, accuracy*1.8) as off, greatest(0.0, least(along_m, {TOTAL!r})) as along_m, {TOTAL!r} - greatest(0.0, least(along_m, {TOTAL!r})) < 25 as here from {PROJECTED})"
_GO = f"({_WANTED.format(c=_COUNT)} and (w.last is null or r.ts_ms - w.last > 15000))"
_CARRIED = [("off_count", "case when off then 1 else 0 end", _COUNT), ("last", f"case when {_FIRST} then ts_ms end", f"case when {_GO} then r.ts_ms else w.last end"), ("arrived", "here", "w.arrived or r.here"), ("arrived_now", "here", "r.here and not w.arrived"), ("reroute", _FIRST, _GO)]
_FOLD = f"with recursive fixes as ({FIXES}), {folded_sql(_ROWS, 'where n = 1', _CARRIED, '*').removeprefix('recursive ')}"
ORACLE_SQL["str1_engine"] = f"select trip_id, event_id, round(along_m,3) as along_m, round(dist_m,3) as dist_m, off, cast(off_count as int) as off_count, here as arrived, arrived_now, reroute from ({_FOLD})"
ORACLE_SQL["win10_reroute"] = f"select trip_id, event_id from ({_FOLD}) where reroute"


def _along(spark, sf_dir):
    checkpointed(spark)
    d = routes.deviation(derived(spark, sf_dir, "fixes"), ROUTE)
    return d.select("trip_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "along_m")


def _throttled_sql(min_s: float, min_m: float) -> str:
    rows = f"select trip_id, epoch_us(ts)//1000 as ts_ms, along_m, row_number() over (partition by trip_id order by epoch_us(ts)//1000, along_m) as n from {PROJECTED}"
    due = f"(r.ts_ms - w.last_ms >= {min_s * 1000} and abs(r.along_m - w.last_m) >= {min_m})"
    carried = [("last_ms", "ts_ms", f"case when {due} then r.ts_ms else w.last_ms end"), ("last_m", "along_m", f"case when {due} then r.along_m else w.last_m end"), ("fires", "true", due)]
    return f"select trip_id, ts_ms, round(along_m,3) as along_m from (with recursive fixes as ({FIXES}), {folded_sql(rows, 'where n = 1', carried, '*').removeprefix('recursive ')}) where fires"


for _name, _s, _m in (("cor5_prefetch_throttle", 15, 1500), ("cor6_eviction_throttle", 60, 0)):
    QUERIES[_name] = lambda spark, sf_dir, _s=_s, _m=_m: routes.throttled(_along(spark, sf_dir), "trip_id", _s, _m).withColumn("along_m", F.round("along_m", 3))
    ORACLE_SQL[_name] = _throttled_sql(_s, _m)
_WITHIN_S = 86_400 * 5
QUERIES["str5_failure_probes"] = lambda spark, sf_dir: checkpointed(spark) or routes.failure_probes(with_millis(derived(spark, sf_dir, "fixes")).withColumn("ok", F.col("accuracy") < 9), "trip_id", 3, _WITHIN_S, "event_id")
_RECENT = f"list_append(list_filter(w.recent, lambda t: r.ts_ms - t < {_WITHIN_S * 1000}), r.ts_ms)"
_PROBES = [("recent", "case when ok then cast([] as bigint[]) else [ts_ms] end", f"case when r.ok or len({_RECENT}) >= 3 then cast([] as bigint[]) else {_RECENT} end"), ("probe", "false", f"not r.ok and len({_RECENT}) >= 3")]
_FAILURES = "select trip_id, epoch_us(ts)//1000 as ts_ms, accuracy < 9 as ok, row_number() over (partition by trip_id order by epoch_us(ts)//1000, event_id) as n from fixes"
ORACLE_SQL["str5_failure_probes"] = f"select trip_id, ts_ms from (with recursive fixes as ({FIXES}), {folded_sql(_FAILURES, 'where n = 1', _PROBES, '*').removeprefix('recursive ')}) where probe"


#: Each day's route is driven for some seconds, at so many metres a second; copies of the trips leave the road after a while.
_MPS, _LEAVES_S = 14.0, 10
_SECONDS, _SECONDS_SQL = lambda: F.col("route_id") % 20 + 5, "(route_id%20+5)"
_OTHER = 1_000_000_000


def _simulated(spark, sf_dir):
    """Fixes of one a second along each day's route, and those of copies that leave the road."""
    driven = routes.spaced(day_legs(spark, sf_dir), F.lit(_MPS), _SECONDS(), "route_id")
    on = driven.select(F.col("route_id").alias("trip_id"), F.col("k").cast("int").alias("t"), "lng", "lat")
    off = routes.off_road(on.withColumn("trip_id", F.col("trip_id") + _OTHER), _LEAVES_S)
    return on.unionByName(off).select("trip_id", "t", F.round("lng", 7).alias("lng"), F.round("lat", 7).alias("lat"))


QUERIES["src12_simulated"] = _simulated
_DRIVEN = f"(select route_id as trip_id, cast(k as int) as t, lng, lat from {points_sql(f'{_MPS!r}e0', _SECONDS_SQL)})"
_LEFT = f"(select trip_id, lng, lat, {brg('ox', 'oy', 'lng', 'lat')} as b from (select *, lag(lng) over w as ox, lag(lat) over w as oy from {_DRIVEN} window w as (partition by trip_id order by t)) where t = {_LEAVES_S})"


def _moved(lng: str, lat: str, bearing: str, metres: str) -> tuple[str, str]:
    d, b, p = f"(({metres})/{geo.R})", f"radians({bearing})", f"radians({lat})"
    q = f"asin(sin({p})*cos({d})+cos({p})*sin({d})*cos({b}))"
    return f"degrees(radians({lng})+atan2(sin({b})*sin({d})*cos({p}), cos({d})-sin({p})*sin({q})))", f"degrees({q})"


_JUMP = _moved("lng", "lat", "b+90", "90.0")
_ON = _moved("jx", "jy", "b+35", f"(t-{_LEAVES_S})*{_MPS}")
ORACLE_SQL["src12_simulated"] = with_derived(f"select cast(trip_id as bigint) as trip_id, t, round(lng,7) as lng, round(lat,7) as lat from (select * from {_DRIVEN} union all select trip_id+{_OTHER}, t, lng, lat from {_DRIVEN} where t < {_LEAVES_S} union all select trip_id+{_OTHER}, t, {_ON[0]}, {_ON[1]} from (select d.trip_id, d.t, l.jx, l.jy, l.b from {_DRIVEN} d join (select trip_id, b, {_JUMP[0]} as jx, {_JUMP[1]} as jy from {_LEFT}) l using (trip_id) where d.t >= {_LEAVES_S}))")
_STOPS = [(5, 0.5), (12, 2.0), (18, 20.0)]
QUERIES["fil12_zoom_interpolation"] = lambda spark, sf_dir: derived(spark, sf_dir, "fixes").select("event_id", F.round(lookups.interpolate(F.col("event_id") % 20 * 1.0, _STOPS, 1.6), 6).alias("w"))
ORACLE_SQL["fil12_zoom_interpolation"] = with_derived("select event_id, round(case when z<=5 then 0.5 when z<12 then 0.5+1.5*(pow(1.6,z-5)-1)/(pow(1.6,7)-1) when z<18 then 2+18*(pow(1.6,z-12)-1)/(pow(1.6,6)-1) else 20 end,6) as w from (select event_id, cast(event_id%20 as double) as z from fixes)")
QUERIES["fil11_style_layer"] = lambda spark, sf_dir: derived(spark, sf_dir, "ways").select("f", "t", lookups.style_layer(F.col("cls"), F.col("f") % 9 == 0, F.col("f") % 16).alias("layer"))
ORACLE_SQL["fil11_style_layer"] = with_derived("select f, t, case when f%9=0 and f%16>=12 then 'link' when cls='motorway' then 'motorway' when cls='secondary' and f%16>=9 then 'secondary' when cls in ('residential','service') and f%16>=12 then 'minor' end as layer from ways")


def _streamed(spark, sf_dir):
    """The events as a stream of files, all there are, as fixes, written as they come to the shared folder."""
    checkpointed(spark)
    out = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/fixes-{uuid.uuid4().hex}"
    events = gps.stream(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(f"{sf_dir}/events.parquet").schema)
    rows = events.select("event_id", F.col("user_id").alias("trip_id"), (F.lit(5.0) + F.col("event_id") % 8 * 4).alias("accuracy"))
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


QUERIES["src11_fix_stream"] = _streamed
ORACLE_SQL["src11_fix_stream"] = "select event_id, user_id as trip_id, cast(5 + event_id%8*4 as double) as accuracy from events"


def _upserted(spark, sf_dir):
    """The orders as a stream of files, as tiles, into a store by batches; then what the store holds."""
    checkpointed(spark)
    out = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tiles-{uuid.uuid4().hex}"
    orders = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/orders.parquet").schema).parquet(f"{sf_dir}/orders.parque[t]")
    rows = spark.sql(f"with orders as (select * from {{orders}}) {TILES}", orders=orders).select("k", "size", "tier", "last_access", "tile_id")
    query = rows.writeStream.foreachBatch(sinks.into(out, "k", ["last_access", "tile_id"])).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sinks.stored(spark, out, rows.schema).select("k", "size", "tier", "last_access")


QUERIES["snk1_stream_upsert"] = _upserted
ORACLE_SQL["snk1_stream_upsert"] = with_derived("select k, arg_max(size, (last_access, tile_id)) as size, arg_max(tier, (last_access, tile_id)) as tier, max(last_access) as last_access from tiles group by k")
