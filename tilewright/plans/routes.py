"""Queries along a route: projections, deviations, steps, corridors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.derive import FIXES, derived, with_derived
from tilewright.functions import geo, tiles
from tilewright.operators import routes
from tilewright.plans import sqls
from tilewright.plans.graph import checkpointed
from tilewright.plans.scalars import brg, hav, seg_sql, tx, ty
from tilewright.plans.sqls import K, values

QUERIES: dict = {}
ORACLE_SQL: dict = {}
C = F.col
ROUTE = [(-77.0, 40.0), (-76.7, 40.09), (-76.35, 40.17), (-76.0, 40.28)]


def projected_sql(route) -> str:
    t, d = seg_sql(K, "ax", "ay", "bx", "by_")
    own = "event_id, trip_id, ts, lng, lat, accuracy"
    return f"(select {own}, arg_min(d, (d, i)) as dist_m, arg_min(i, (d, i)) as idx, arg_min(t, (d, i)) as t, arg_min(before + t*n, (d, i)) as along_m from (select f.*, s.i, s.before, s.n, {t} as t, {d} as d from fixes f, {values(routes.segments(route))}) group by {own})"


def deviated_sql(route) -> str:
    w = "partition by trip_id order by ts, event_id rows unbounded preceding"
    return f"(select *, s - least(0, min(s) over ({w})) as off_count from (select *, sum(case when off then 1 else -1 end) over ({w}) as s from (select *, dist_m > greatest(35, accuracy*1.8) as off from {projected_sql(route)})))"


def length_of(route) -> float:
    return sum(s[-1] for s in routes.segments(route))


PROJECTED, DEVIATED = projected_sql(ROUTE), deviated_sql(ROUTE)


def register(name, build, sql=None, source="fixes") -> None:
    QUERIES[name] = lambda spark, sf_dir: build(derived(spark, sf_dir, source))
    if sql:
        ORACLE_SQL[name] = with_derived(sql)


def r(name, c, n=3):
    return F.round(c, n).alias(name)


def _geo6(d):
    p = d.select("event_id", routes.project_onto_path(C("lng"), C("lat"), ROUTE).alias("p"))
    return p.select("event_id", C("p.index").alias("idx"), r("t", C("p.t"), 6), r("dist_m", C("p.dist_m")), r("along_m", C("p.along_m")))


register("geo6_project", _geo6, f"select event_id, idx, round(t,6) as t, round(dist_m,3) as dist_m, round(along_m,3) as along_m from {PROJECTED}")
register("win8_deviation", lambda d: routes.deviation(d, ROUTE).select("event_id", "trip_id", r("dist_m", C("dist_m")), "off", C("off_count").cast("long")), f"select event_id, trip_id, round(dist_m,3) as dist_m, off, cast(off_count as bigint) as off_count from {DEVIATED}")
TOTAL = length_of(ROUTE)
#: A route that ends before the fixes do: those beyond it are nearest to its end.
SHORT = ROUTE[:3]


def arrivals(d, route):
    """The first fix of each trip within 25 m of the route's end."""
    end = length_of(route)
    there = routes.deviation(d, route).where(F.lit(end) - F.least(C("along_m"), F.lit(end)) < 25)
    return there.groupBy("trip_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("trip_id", "f.ts", "f.event_id")


register("win9_arrival", lambda d: arrivals(d, SHORT), f"select trip_id, min(ts) as ts, arg_min(event_id, (ts, event_id)) as event_id from {deviated_sql(SHORT)} where {length_of(SHORT)!r} - least(along_m, {length_of(SHORT)!r}) < 25 group by trip_id")
W = lambda: Window.partitionBy("trip_id").orderBy("ts", "event_id")


def _course(d):
    dx = F.radians(C("lng") - F.lag("lng").over(W())) * F.cos(F.radians("lat"))
    dy = F.radians(C("lat") - F.lag("lat").over(W()))
    return d.select("event_id", r("heading", F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0)), 4))


_CX = "(radians(lng - lag(lng) over w)*cos(radians(lat)))"
_CA = f"(degrees(atan2({_CX}, radians(lat - lag(lat) over w)))+360)"
register("geo19_course", _course, f"select event_id, round({_CA} - 360*floor({_CA}/360),4) as heading from fixes window w as (partition by trip_id order by ts, event_id)")
register("win11_heading", lambda d: _course(d).where("heading is not null"), f"select * from (select event_id, round({_CA} - 360*floor({_CA}/360),4) as heading from fixes window w as (partition by trip_id order by ts, event_id)) where heading is not null")
register("str4_stale_gps", lambda d: d.select("event_id", "trip_id", (F.lead("ts").over(W()).cast("timestamp").cast("double") - C("ts").cast("timestamp").cast("double")).alias("gap")).where("gap > 12").select("event_id", "trip_id", r("gap", C("gap"))), "select event_id, trip_id, round(gap,3) as gap from (select event_id, trip_id, epoch(lead(ts) over (partition by trip_id order by ts, event_id)) - epoch(ts) as gap from fixes) where gap > 12")


def _segments(d):
    return d.select("trip_id", C("lng").alias("ax"), C("lat").alias("ay"), F.lead("lng").over(W()).alias("bx"), F.lead("lat").over(W()).alias("by"), "event_id").where("bx is not null")


_SEG = "(select trip_id, event_id, ts, lng as ax, lat as ay, lead(lng) over (partition by trip_id order by ts, event_id) as bx, lead(lat) over (partition by trip_id order by ts, event_id) as by_ from fixes)"
register("win4_segments", lambda d: _segments(d).select("trip_id", "event_id", r("m", geo.haversine_m(C("ax"), C("ay"), C("bx"), C("by")))), f"select trip_id, event_id, round({hav('ax', 'ay', 'bx', 'by_')},3) as m from {_SEG} where bx is not null")
register("geo8_path_length", lambda d: _segments(d).groupBy("trip_id").agg(r("m", F.sum(geo.haversine_m(C("ax"), C("ay"), C("bx"), C("by"))), 2)), f"select trip_id, round(sum({hav('ax', 'ay', 'bx', 'by_')}),2) as m from {_SEG} where bx is not null group by trip_id")
register("win1_cumulative", lambda d: d.select("event_id", "trip_id", "ts", F.coalesce(geo.haversine_m(F.lag("lng").over(W()), F.lag("lat").over(W()), C("lng"), C("lat")), F.lit(0.0)).alias("m")).select("event_id", r("cum_m", F.sum("m").over(W()), 2)), f"select event_id, round(sum(m) over (partition by trip_id order by ts, event_id),2) as cum_m from (select event_id, trip_id, ts, coalesce({hav('lag(lng) over w', 'lag(lat) over w', 'lng', 'lat')},0) as m from fixes window w as (partition by trip_id order by ts, event_id))")
register("win2_step_distance", lambda d: d.select("event_id", r("next_m", geo.planar_m(C("lng"), C("lat"), F.lead("lng").over(W()), F.lead("lat").over(W())))), f"select event_id, round(sqrt(pow(radians(lead(lng) over w - lng)*cos(radians(lat)),2)+pow(radians(lead(lat) over w - lat),2))*{geo.R},3) as next_m from fixes window w as (partition by trip_id order by ts, event_id)")
register("geo10_bbox", lambda d: d.groupBy("trip_id").agg(F.min("lng").alias("min_lng"), F.min("lat").alias("min_lat"), F.max("lng").alias("max_lng"), F.max("lat").alias("max_lat")), "select trip_id, min(lng) as min_lng, min(lat) as min_lat, max(lng) as max_lng, max(lat) as max_lat from fixes group by trip_id")
register("geo20_fit_bounds", lambda d: d.agg(F.min("lng").alias("min_lng"), F.min("lat").alias("min_lat"), F.max("lng").alias("max_lng"), F.max("lat").alias("max_lat")), "select min(lng) as min_lng, min(lat) as min_lat, max(lng) as max_lng, max(lat) as max_lat from fixes")
register("agg5_average_lat", lambda d: d.groupBy("trip_id").agg(r("lat", F.avg("lat"), 8)), "select trip_id, round(avg(lat),8) as lat from fixes group by trip_id")

# Points and slices along the route
_AT = lambda: C("event_id") % 100 * 1000.0
_PS = routes.segments(ROUTE, routes.planar)
_PT = f"(select event_id, m_at, arg_min(ax + (case when n=0 then 0 else (m_at-before)/n end)*(bx-ax), i) as lng, arg_min(ay + (case when n=0 then 0 else (m_at-before)/n end)*(by_-ay), i) as lat from (select event_id, cast(event_id%100*1000 as double) as m_at from fixes) f left join {values(_PS)} on m_at <= before+n group by event_id, m_at)"


def _at(d):
    p = d.select("event_id", routes.point_at_distance(_AT(), ROUTE).alias("p"))
    return p.select("event_id", r("lng", C("p.lng"), 8), r("lat", C("p.lat"), 8))


register("geo13_point_at_distance", _at, f"select event_id, round(coalesce(lng,{ROUTE[-1][0]}),8) as lng, round(coalesce(lat,{ROUTE[-1][1]}),8) as lat from {_PT}")
register("geo14_slice_route", lambda d: d.select("event_id", F.size(routes.slice_route(_AT(), _AT() + 30000, ROUTE)).alias("n")), f"select event_id, cast(1 + count(case when before+n > a and before < b then 1 end) as int) as n from (select event_id, least(event_id%100*1000.0, {TOTAL}) as a, greatest(least(event_id%100*1000.0,{TOTAL}), least(event_id%100*1000.0+30000, {TOTAL})) as b from fixes), {values(_PS)} group by event_id")
register("geo16_travelled", lambda d: d.select("event_id", F.size(routes.slice_route(F.lit(0.0), _AT(), ROUTE)).alias("n")), f"select event_id, cast(1 + count(case when before+n > 0 and before < b then 1 end) as int) as n from (select event_id, greatest(0, least(event_id%100*1000.0, {TOTAL})) as b from fixes), {values(_PS)} group by event_id")
register("agg12_progress", lambda d: routes.deviation(d, ROUTE).select("event_id", F.least(F.lit(100.0), F.round(C("along_m") / TOTAL * 100, 3)).alias("percent")), f"select event_id, least(100.0, round(along_m/{TOTAL}*100,3)) as percent from {PROJECTED}")
register("geo18_distance_to_path", lambda d: d.groupBy("trip_id").agg(r("m", F.min(routes.project_onto_path(C("lng"), C("lat"), ROUTE)["dist_m"]))), f"select trip_id, round(min(dist_m),3) as m from {PROJECTED} group by trip_id")

# Steps: (number, type, cumulative metres and seconds); the last ends the route.
STEPS = [(0, "depart", 0.0, 0.0), (1, "turn", 27000.0, 1500.0), (2, "continue", 58000.0, 3100.0), (3, "arrive", TOTAL, 5400.0)]
#: The line that the fixes follow, with its steps: here fixes come near each of them.
LINE = [(-77.0, 40.0), (-76.0, 40.28)]
LINE_STEPS = [*STEPS[:3], (3, "arrive", length_of(LINE), 5400.0)]


def navigation(d, steps=None):
    """Progress, remaining time and the next manoeuvre of every fix; the distance to an arrival is that to the end.

    The step is the first that ends at or after the place, or the last."""
    steps = steps or STEPS
    total = steps[-1][2]
    ends = [F.struct(F.lit(i + 1).alias("next"), *[F.lit(v).alias(n) for n, v in (("m0", a[2]), ("s0", a[3]), ("m1", b[2]), ("s1", b[3]))]) for i, (a, b) in enumerate(zip(steps, steps[1:], strict=False))]
    d = d.withColumn("_a", F.greatest(F.lit(0.0), F.least(C("along_m"), F.lit(total))))
    d = d.withColumn("_s", F.coalesce(F.try_element_at(F.filter(F.array(*ends), lambda s: C("_a") <= s["m1"]), F.lit(1)), ends[-1]))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (C("_a") - C("_s.m0")) / F.greatest(F.lit(1.0), C("_s.m1") - C("_s.m0"))))
    left = F.lit(steps[-1][3]) - (C("_s.s0") + share * (C("_s.s1") - C("_s.s0")))
    return d.select("event_id", "trip_id", "ts", r("along_m", C("_a")), r("remaining_m", F.lit(total) - C("_a")), r("remaining_s", left), C("_s.next").alias("next_step"), r("to_step_m", C("_s.m1") - C("_a")), "off", C("off_count").cast("long").alias("off_count"), (F.lit(total) - C("_a") < 25).alias("arrived"))


def navigation_sql(route, steps) -> str:
    total, last = steps[-1][2], len(steps) - 1
    rows = ", ".join(f"({i}, {m!r}, {s!r}, {steps[min(i + 1, last)][2]!r}, {steps[min(i + 1, last)][3]!r})" for i, _, m, s in steps)
    return f"(select event_id, trip_id, ts, round(a,3) as along_m, round({total!r}-a,3) as remaining_m, round({steps[-1][3]!r}-(s0+greatest(0.0,least(1.0,(a-m0)/greatest(1.0,m1-m0)))*(s1-s0)),3) as remaining_s, cast(j+1 as int) as next_step, round(m1-a,3) as to_step_m, off, cast(off_count as bigint) as off_count, {total!r}-a < 25 as arrived from (select d.*, greatest(0.0, least(along_m, {total!r})) as a from {deviated_sql(route)} d) x, (values {rows}) st(j, m0, s0, m1, s1) where j < {last} and (a <= m1 or j = {last - 1}) and (j = 0 or a > m0))"


_NAV, _LINE_NAV = navigation_sql(ROUTE, STEPS), navigation_sql(LINE, LINE_STEPS)
for _name, _cols in (
    ("str1_navigation", ["event_id", "trip_id", "along_m", "remaining_m", "remaining_s", "next_step", "to_step_m", "off", "off_count", "arrived"]),
    ("str2_remaining_time", ["event_id", "remaining_s"]),
    ("str3_next_manoeuvre", ["event_id", "next_step", "to_step_m"]),
    ("jon12_step_interval", ["event_id", "next_step"]),
    ("jon11_fix_to_route", ["event_id", "along_m", "off"]),
):
    register(_name, lambda d, _c=_cols: navigation(routes.deviation(d, ROUTE)).select(*_c), f"select {', '.join(_cols)} from {_NAV}")


def announced(d, route, steps):
    """(trip_id, ts, event_id, next_step, milestone): what is said to each trip, each milestone of a step once. Before a
    manoeuvre the least of 2000, 800 and 200 m that is reached, before the arrival 300 m; nothing off the route."""
    n = navigation(routes.deviation(d, route), steps).where("not off")
    before = F.when(C("to_step_m") <= 200, 200).when(C("to_step_m") <= 800, 800).when(C("to_step_m") <= 2000, 2000)
    n = n.withColumn("milestone", F.when(C("next_step") < len(steps) - 1, before).when(C("to_step_m") <= 300, 300)).where("milestone is not null")
    return n.groupBy("trip_id", "next_step", "milestone").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("trip_id", "f.ts", "f.event_id", "next_step", "milestone")


_ANNOUNCED = f"(select trip_id, min(ts) as ts, arg_min(event_id, (ts, event_id)) as event_id, next_step, milestone from (select *, cast(case when next_step < 3 then (case when to_step_m<=200 then 200 when to_step_m<=800 then 800 when to_step_m<=2000 then 2000 end) when to_step_m<=300 then 300 end as int) as milestone from {_LINE_NAV} where not off) where milestone is not null group by trip_id, next_step, milestone)"
register("str7_voice_milestones", lambda d: announced(d, LINE, LINE_STEPS), f"select trip_id, ts, event_id, next_step, milestone from {_ANNOUNCED}")
register("str7_voice_milestones_whole", lambda d: announced(d, ROUTE, STEPS).select("trip_id", "next_step", "milestone"))
# Every fix says something, on a clock so fast that some come too soon; every eighth interrupts.
_SAID_MS = lambda: F.floor(F.unix_millis(C("ts").cast("timestamp")) / 20_000)


def _str8(d):
    checkpointed(d.sparkSession)
    return routes.said(d.select("trip_id", "event_id", _SAID_MS().alias("ts_ms"), (C("event_id") % 8 == 0).alias("interrupt")), "trip_id", 1500).select("event_id", "ts_ms", "interrupt")


def folded_sql(rows: str, first: str, carried: list[tuple[str, str, str]], out: str) -> str:
    """A fold over each trip's `rows` in the order of n: of each carried (name, its first value, its next from w and r)."""
    names = [c[0] for c in carried]
    return f"recursive numbered as ({rows}), walk(trip_id, n, {', '.join(names)}) as (select trip_id, n, {', '.join(c[1] for c in carried)} from numbered {first} union all select r.trip_id, r.n, {', '.join(c[2] for c in carried)} from walk w join numbered r on r.trip_id = w.trip_id and r.n = w.n + 1) select {out} from walk w join numbered r using (trip_id, n)"


def register_fold(name, build, rows, carried, out) -> None:
    register(name, build)
    ORACLE_SQL[name] = f"with recursive fixes as ({FIXES}), {folded_sql(rows, 'where n = 1', carried, out).removeprefix('recursive ')}"


_NUMBERED = "row_number() over (partition by trip_id order by {o}) as n"
register_fold(
    "str8_throttle",
    _str8,
    f"select trip_id, event_id, ms as ts_ms, event_id%8=0 as interrupt, {_NUMBERED.format(o='ms, event_id')} from (select *, cast(floor(epoch_us(ts)/20000000.0) as bigint) as ms from fixes)",
    [("last", "ts_ms", "case when r.interrupt or r.ts_ms - w.last >= 1500 then r.ts_ms else w.last end"), ("spoken", "true", "r.interrupt or r.ts_ms - w.last >= 1500")],
    "event_id, ts_ms, interrupt where false",
)
ORACLE_SQL["str8_throttle"] = ORACLE_SQL["str8_throttle"].replace("select event_id, ts_ms, interrupt where false from walk w join numbered r using (trip_id, n)", "select event_id, ts_ms, interrupt from walk w join numbered r using (trip_id, n) where spoken")
register("str8_throttle_whole", lambda d: checkpointed(d.sparkSession) or routes.throttled(d.select("trip_id", F.unix_millis(C("ts").cast("timestamp")).alias("ts_ms"), C("event_id").alias("along_m")), "trip_id", 1.5, 0).select(C("along_m").alias("event_id")))
register("str6_state_changes", lambda d: d.withColumn("state", F.when(C("accuracy") > 25, "offline").when(C("accuracy") > 15, "degraded").otherwise("online")).withColumn("last", F.lag("state").over(W())).where("last is null or last <> state").select("event_id", "state"), "select event_id, state from (select event_id, state, lag(state) over (partition by trip_id order by ts, event_id) as last from (select *, case when accuracy>25 then 'offline' when accuracy>15 then 'degraded' else 'online' end as state from fixes)) where last is null or last <> state")
register("srt8_last_four", lambda d: d.withColumn("n", F.row_number().over(Window.partitionBy("trip_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 4").select("trip_id", "event_id"), "select trip_id, event_id from (select trip_id, event_id, row_number() over (partition by trip_id order by ts desc, event_id desc) as n from fixes) where n <= 4")


def _turns(d):
    """The turn at each fix from the line that leads to it to the one that leads on."""
    at = d.select("event_id", F.lag("lng").over(W()).alias("ax"), F.lag("lat").over(W()).alias("ay"), "lng", "lat", F.lead("lng").over(W()).alias("bx"), F.lead("lat").over(W()).alias("by")).where("ax is not null and bx is not null")
    turn = geo.angle_diff(geo.bearing_deg(C("ax"), C("ay"), C("lng"), C("lat")), geo.bearing_deg(C("lng"), C("lat"), C("bx"), C("by")))
    return at.select("event_id", (F.round(turn, 4) + F.lit(0.0)).alias("delta"))  # no negative zeros


register("win5_turn_delta", _turns, f"select event_id, round(case when d = -180 then 180 else d end,4) + 0e0 as delta from (select event_id, x - 360*floor(x/360) - 180 as d from (select event_id, {brg('lng', 'lat', 'bx', 'by_')} - {brg('ax', 'ay', 'lng', 'lat')} + 540 as x from (select *, lag(lng) over w as ax, lag(lat) over w as ay, lead(lng) over w as bx, lead(lat) over w as by_ from fixes window w as (partition by trip_id order by ts, event_id)) where ax is not null and bx is not null))")
_THIN_M = 100.0
_FLAT = f"select trip_id, event_id, row_number() over w - 1 as n, lng*{geo.DEGREE_M}*cos(radians(first_value(lat) over w)) as x, lat*{geo.DEGREE_M} as y from fixes window w as (partition by trip_id order by ts, event_id)"
_ON = "least(1, greatest(0, case when (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) > 0 then ((p.x-ax)*(bx-ax)+(p.y-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) else 0 end))"
_STRETCHES = "select v.trip_id, v.a, v.b, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from stretch v join pts a on a.trip_id=v.trip_id and a.n=v.a join pts b on b.trip_id=v.trip_id and b.n=v.b"
_SPLITS = f"select trip_id, a, b, arg_max(n, (d, -n)) as at_n, max(d) as far from (select v.trip_id, v.a, v.b, p.n, sqrt(pow(p.x-ax-{_ON}*(bx-ax),2)+pow(p.y-ay-{_ON}*(by_-ay),2)) as d from ({_STRETCHES}) v join pts p on p.trip_id=v.trip_id and p.n > v.a and p.n < v.b) group by all"
register("geo9_simplified", lambda d: checkpointed(d.sparkSession) or routes.simplified(d, "trip_id", ["ts", "event_id"], _THIN_M, F.to_date("ts")).select("trip_id", "event_id"))
ORACLE_SQL["geo9_simplified"] = f"with recursive fixes as ({FIXES}), pts as ({_FLAT}), stretch(trip_id, a, b) as (select trip_id, cast(0 as bigint), max(n) from pts group by trip_id union all select trip_id, s.a, s.b from (select trip_id, unnest([{{'a': a, 'b': at_n}}, {{'a': at_n, 'b': b}}]) as s from ({_SPLITS}) where far > {_THIN_M})) select trip_id, event_id from pts where (trip_id, n) in (select (trip_id, a) from stretch union select (trip_id, b) from stretch)"

# Corridors

#: Metres round ends and manoeuvres.
DETAIL_M = 2000.0


def _segments_df(spark, segs):
    return spark.createDataFrame(segs, "i int, ax double, ay double, bx double, by double, before double, n double")


def plan_sql_legs() -> str:
    """The legs of each day's route with what routes.legs() adds to them."""
    w = "window w as (partition by route_id order by ts, event_id)"
    own = f"(select *, sqrt(pow(radians(bx-ax)*cos(radians(ay)),2)+pow(radians(by_-ay),2))*{geo.R} as n, {hav('ax', 'ay', 'bx', 'by_')} as m from (select route_id, event_id, ts, row_number() over w - 1 as i, lng as ax, lat as ay, lead(lng) over w as bx, lead(lat) over w as by_, avg(lat) over (partition by route_id) as lat from trips {w}) where bx is not null)"
    return f"(select *, coalesce(sum(n) over (w rows between unbounded preceding and 1 preceding), 0) as before, sum(m) over (partition by route_id) as total, lead(i) over w is null as last from {own} {w})"


LEGS_SQL = plan_sql_legs()


def day_legs(spark, sf_dir):
    return routes.legs(derived(spark, sf_dir, "trips"), "route_id", ["ts", "event_id"])


def register_trips(name, build, sql) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(day_legs(spark, sf_dir))
    ORACLE_SQL[name] = with_derived(sql)


ALL = 1 << 30
register_trips("jon7_corridor", lambda d: routes.corridors(d, "route_id", 13, 2000.0, ALL).select("route_id", "x", "y"), f"select route_id, x, y from {sqls.corridors(LEGS_SQL, 'route_id', 13, 2000.0, ALL)}")
#: Some days' corridors fit at once, others only when they have shrunk.
WIDE_M, WIDE_CAP = 6000.0, 110
register_trips("cor1_corridor_within", lambda d: routes.corridors(d, "route_id", 13, WIDE_M, WIDE_CAP).select("route_id", "z", "x", "y"), f"select * from {sqls.corridors(LEGS_SQL, 'route_id', 13, WIDE_M, WIDE_CAP)}")


def plan_tiles(spark, sf_dir):
    """The route's overview at zooms 6 to 12, its corridor at 13, and at 14 what is round its ends and manoeuvres."""
    corridor = routes.corridor_within(_segments_df(spark, routes.segments(ROUTE)), 13, 2000.0, 1400)[0]
    detail = routes.corridor_within(_segments_df(spark, _anchors()), 14, DETAIL_M, 500)[0]
    return _overview(spark, sf_dir).unionByName(corridor).unionByName(detail)


def _anchors():
    """The route's ends and manoeuvres, as segments of no length."""
    at = [0.0, *(m for _, kind, m, _ in STEPS if kind not in ("depart", "arrive")), TOTAL]
    points = [routes.sliced(ROUTE, m, m)[0] for m in at]
    return [(i, *p, *p, 0.0, 0.0) for i, p in enumerate(points)]


_overview = lambda spark, sf_dir: spark.range(6, 13).select(C("id").cast("int").alias("z")).withColumn("n", F.greatest(F.lit(1), F.ceil(F.lit(TOTAL) / (tiles.tile_width_m(C("z"), F.lit(40.1)) * 0.5))).cast("int")).select("z", "n", F.explode(F.sequence(F.lit(0), C("n"))).alias("i")).withColumn("p", routes.point_at_distance(C("i") / C("n") * TOTAL, ROUTE)).select("z", tiles.tile_x(C("p.lng"), C("z")).alias("x"), tiles.tile_y(C("p.lat"), C("z")).alias("y")).distinct()


def points_sql(step: str, most: str, legs: str = LEGS_SQL) -> str:
    """(route_id, k, lng, lat) of the points k * step along each route; the end beyond the end."""
    at = lambda a, b: f"arg_min({a} + (case when n=0 then 0 else (at_m-before)/n end)*({b}-{a}), i)"
    asked = f"(select route_id, k, k*step as at_m from (select route_id, any_value({step}) as step, any_value({most}) as most from {legs} group by route_id), unnest(range(0, cast(most as bigint)+1)) as ks(k))"
    inside = f"(select route_id, k, {at('ax', 'bx')} as lng, {at('ay', 'by_')} as lat from {asked} join {legs} l using (route_id) where at_m <= before+n group by all)"
    return f"(select route_id, k, coalesce(p.lng, e.bx) as lng, coalesce(p.lat, e.by_) as lat from {asked} left join {inside} p using (route_id, k) join (select route_id, bx, by_ from {legs} where last) e using (route_id))"


#: Half a tile's width along the route; how many such steps an overview of zoom z takes.
_STEPS = lambda z: F.greatest(F.lit(1), F.ceil(C("total") / (tiles.tile_width_m(F.lit(z), C("lat")) * 0.5)))
_STEPS_SQL = lambda z: f"greatest(1, ceil(total/({tiles.EQUATOR_M}*cos(radians(lat))/{2**z}*0.5)))"
OVERVIEW = range(6, 13)


def anchors(points):
    """Segments of no length at each route's ends and where it turns by 25 degrees or more."""
    w = Window.partitionBy("route_id").orderBy("ts", "event_id")
    p = points.select("route_id", "lng", "lat", F.lag("lng").over(w).alias("ax"), F.lag("lat").over(w).alias("ay"), F.lead("lng").over(w).alias("bx"), F.lead("lat").over(w).alias("by")).where("ax is not null or bx is not null")
    turn = geo.angle_diff(geo.bearing_deg(C("ax"), C("ay"), C("lng"), C("lat")), geo.bearing_deg(C("lng"), C("lat"), C("bx"), C("by")))
    return p.where(C("ax").isNull() | C("bx").isNull() | (F.abs(turn) >= 25)).select("route_id", C("lng").alias("ax"), C("lat").alias("ay"), C("lng").alias("bx"), C("lat").alias("by"), (C("ax").isNotNull() & C("bx").isNotNull()).alias("turns"))


_TURN = f"{brg('lng', 'lat', 'bx', 'by_')} - {brg('ax', 'ay', 'lng', 'lat')} + 540"
ANCHORS_SQL = f"(select route_id, lng as ax, lat as ay, lng as bx, lat as by_, turns from (select *, ax is not null and bx is not null as turns, abs(({_TURN}) - 360*floor(({_TURN})/360) - 180) as turn from (select route_id, ts, event_id, lng, lat, lag(lng) over w as ax, lag(lat) over w as ay, lead(lng) over w as bx, lead(lat) over w as by_ from trips window w as (partition by route_id order by ts, event_id))) where (ax is not null or bx is not null) and (ax is null or bx is null or turn >= 25))"


def trip_plans(spark, sf_dir):
    """(route_id, z, x, y): each day's overview at zooms 6 to 12, its corridor at 13, and at 14 what is round its ends and turns."""
    d = day_legs(spark, sf_dir)
    out = routes.corridors(d, "route_id", 13, 2000.0, 1400).unionByName(routes.corridors(anchors(derived(spark, sf_dir, "trips")), "route_id", 14, DETAIL_M, 500)).select("route_id", "z", "x", "y")
    for z in OVERVIEW:
        at = routes.spaced(d, C("total") / _STEPS(z), _STEPS(z), "route_id")
        out = out.unionByName(at.select("route_id", F.lit(z).alias("z"), tiles.tile_x(C("lng"), F.lit(z)).alias("x"), tiles.tile_y(C("lat"), F.lit(z)).alias("y")).distinct())
    return out


QUERIES["cor2_overview"] = trip_plans
ORACLE_SQL["cor2_overview"] = with_derived(
    " union all ".join(
        [f"select route_id, z, x, y from {sqls.corridors(LEGS_SQL, 'route_id', 13, 2000.0, 1400)}", f"select route_id, z, x, y from {sqls.corridors(ANCHORS_SQL, 'route_id', 14, DETAIL_M, 500)}"]
        + [f"select distinct route_id, cast({z} as int) as z, {tx('lng', z)} as x, {ty('lat', z)} as y from {points_sql(f'total/{_STEPS_SQL(z)}', _STEPS_SQL(z))}" for z in OVERVIEW]
    )
)
register_trips("win12_route_samples", lambda d: routes.spaced(d, C("total") / 100, F.lit(100), "route_id").select("route_id", C("k").cast("int").alias("i"), r("lng", C("lng"), 7), r("lat", C("lat"), 7)), f"select route_id, cast(k as int) as i, round(lng,7) as lng, round(lat,7) as lat from {points_sql('total/100', '100')}")
#: Where on a day's route the look-ahead starts, and how fast: the fast ones reach further than three times the detail.
AHEAD_SHARE, AHEAD_DETAIL_M = 0.3, 1500.0
_SPEED, _SPEED_SQL = lambda: C("route_id") % 4 * 10.0, "(route_id%4*10.0)"


def _ahead(d):
    along = C("total") * AHEAD_SHARE
    return routes.corridors(routes.clipped(d, along - AHEAD_DETAIL_M, along + F.greatest(F.lit(3 * AHEAD_DETAIL_M), _SPEED() * routes.AHEAD_S)), "route_id", 14, AHEAD_DETAIL_M, routes.AHEAD_CAP).select("route_id", "z", "x", "y")


_CLIPPED = f"(select route_id, case when before < a then ax + (a-before)/n*(bx-ax) else ax end as ax, case when before < a then ay + (a-before)/n*(by_-ay) else ay end as ay, bx, by_ from (select *, greatest(a, least(e, total)) as b from (select *, greatest(0, least(total*{AHEAD_SHARE}-{AHEAD_DETAIL_M}, total)) as a, total*{AHEAD_SHARE} + greatest({3 * AHEAD_DETAIL_M}, {_SPEED_SQL}*{routes.AHEAD_S}) as e from {LEGS_SQL})) where before+n > a and before < b)"
register_trips("cor3_predictive", _ahead, f"select * from {sqls.corridors(_CLIPPED, 'route_id', 14, AHEAD_DETAIL_M, routes.AHEAD_CAP)}")


# What a route's corridor and its detail want together, each tile once: the corridor's tiles at the detail's zoom are their
# four children.
def _wanted_together(spark, sf_dir):
    d = routes.corridors(day_legs(spark, sf_dir), "route_id", 13, 2000.0, 1400)
    children = d.select(F.lit(14).alias("z"), F.explode(F.array(C("x") * 2, C("x") * 2 + 1)).alias("x"), "y").select("z", "x", F.explode(F.array(C("y") * 2, C("y") * 2 + 1)).alias("y"))
    detail = routes.corridors(anchors(derived(spark, sf_dir, "trips")), "route_id", 14, DETAIL_M, 500).select("z", "x", "y")
    return children.unionByName(detail).distinct()


QUERIES["set1_union_distinct"] = _wanted_together
ORACLE_SQL["set1_union_distinct"] = with_derived(f"select cast(14 as int) as z, x, y from (select distinct cast(x*2+i as int) as x, cast(y*2+j as int) as y from {sqls.corridors(LEGS_SQL, 'route_id', 13, 2000.0, 1400)}, (values (0), (1)) a(i), (values (0), (1)) b(j) union select x, y from {sqls.corridors(ANCHORS_SQL, 'route_id', 14, DETAIL_M, 500)})")


def _feature(geometry, **properties):
    return F.struct(F.lit("Feature").alias("type"), F.struct(*[v.alias(k) for k, v in properties.items()] or [F.lit(True).alias("ok")]).alias("properties"), geometry.alias("geometry"))


def _shape(kind, coordinates):
    return F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))


def _geojson(spark, sf_dir):
    """Each day's route, its turns and its end as features of a map; a route is a row."""
    points = derived(spark, sf_dir, "trips").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "lng", "lat"))).alias("p")).where(F.size("p") > 1)
    at = lambda p: F.array(p["lng"], p["lat"])
    lines = points.select("route_id", F.lit("route").alias("what"), _feature(_shape("LineString", F.transform("p", at))).alias("f"))
    ends = points.select("route_id", F.lit("destination").alias("what"), _feature(_shape("Point", at(F.element_at("p", -1)))).alias("f"))
    turns = anchors(derived(spark, sf_dir, "trips")).where("turns").select("route_id", F.lit("manoeuvre").alias("what"), _feature(_shape("Point", F.array("ax", "ay")), type=F.lit("turn")).alias("f"))
    out = None
    for rows in (lines, turns, ends):
        rows = rows.select("route_id", "what", F.to_json("f").alias("geojson"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _geojson_sql() -> str:
    ok, turn = '"properties":{"ok":true}', '"properties":{"type":"turn"}'
    text = lambda x, y: f"concat('[', {x}, ',', {y}, ']')"
    frame = lambda kind, props, c: f"""concat('{{"type":"Feature",{props},"geometry":{{"type":"{kind}","coordinates":', {c}, '}}}}')"""
    line = f"concat('[', string_agg({text('lng', 'lat')}, ',' order by ts, event_id), ']')"
    lines = f"select route_id, 'route' as what, {frame('LineString', ok, line)} as geojson from trips group by route_id having count(*) > 1"
    ends = f"select route_id, 'destination' as what, {frame('Point', ok, text('arg_max(lng, (ts, event_id))', 'arg_max(lat, (ts, event_id))'))} as geojson from trips group by route_id having count(*) > 1"
    turns = f"select route_id, 'manoeuvre' as what, {frame('Point', turn, text('ax', 'ay'))} as geojson from {ANCHORS_SQL} where turns"
    return f"{lines} union all {turns} union all {ends}"


QUERIES["src14_route_geojson"] = _geojson
ORACLE_SQL["src14_route_geojson"] = with_derived(_geojson_sql())
