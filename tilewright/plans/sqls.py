"""SQL of the oracle that several plans share: projections onto a route and tiles of a corridor."""

from __future__ import annotations

from tilewright.functions import geo
from tilewright.operators import routes
from tilewright.plans.scalars import north, seg_sql, tx, ty, west

K = f"({geo.R}*pi()/180)"


def values(segs) -> str:
    say = lambda v: repr(v) if isinstance(v, int) or "e" in repr(v) else f"{v!r}e0"  # noqa: E731 - doubles, not decimals
    return "(values " + ", ".join("(" + ", ".join(say(v) for v in s) + ")" for s in segs) + ") s(i, ax, ay, bx, by_, before, n)"


def projected(source: str, key: str, route) -> str:
    """(source's columns, dist_m, along_m) for a relation with columns lng and lat and the unique `key`."""
    t, d = seg_sql(K, "ax", "ay", "bx", "by_")
    near = f"select {key}, min(d) as dist_m, arg_min(before + t*n, (d, i)) as along_m from (select p.*, s.i, s.before, s.n, {t} as t, {d} as d from {source} p, {values(routes.segments(route))}) group by {key}"
    return f"(select * from {source} join ({near}) using ({key}))"


def corridor(segs, z: int, radius: float) -> str:
    """(x, y) of the tiles whose centre is within radius and half a tile of a segment."""
    wide = "/greatest(0.05,cos(radians((ay+by_)/2)))"
    lng, lat = f"(({west('x', z)}+{west('x+1', z)})/2)", f"(({north('y', z)}+{north('y+1', z)})/2)"
    boxes = f"select s.*, least(ax,bx)-dl{wide} as x0, greatest(ax,bx)+dl{wide} as x1, least(ay,by_)-dl as y0, greatest(ay,by_)+dl as y1 from (select *, degrees({radius * 2.0!r}/{geo.R}) as dl from {values(segs)}) s"
    cells = f"select *, unnest(range({ty('y1', z)}, {ty('y0', z)}+1)) as y from (select *, unnest(range({tx('x0', z)}, {tx('x1', z)}+1)) as x from ({boxes}))"
    near = seg_sql("111320.0", "ax", "ay", "bx", "by_")[1]
    return f"(select distinct cast(x as int) as x, cast(y as int) as y from (select *, {lng} as lng, {lat} as lat from ({cells})) where {near} <= {radius!r} + 360.0/{2**z}*111320*cos(radians(ay))/2)"


def corridors(segs: str, key: str, z: int, radius: float, cap: int) -> str:
    """(key, z, x, y) of the corridors of the lines in segs (key, ax, ay, bx, by_), each at the largest of its radii that
    has no more than cap tiles; a radius after the other is tried."""
    wide = "/greatest(0.05,cos(radians((ay+by_)/2)))"
    lng, lat = f"(({west('x', z)}+{west('x+1', z)})/2)", f"(({north('y', z)}+{north('y+1', z)})/2)"
    boxes = f"select s.*, least(ax,bx)-dl{wide} as x0, greatest(ax,bx)+dl{wide} as x1, least(ay,by_)-dl as y0, greatest(ay,by_)+dl as y1 from (select {key}, ax, ay, bx, by_, degrees({radius * 2.0!r}/{geo.R}) as dl from {segs}) s"
    cells = f"select *, unnest(range({ty('y1', z)}, {ty('y0', z)}+1)) as y from (select *, unnest(range({tx('x0', z)}, {tx('x1', z)}+1)) as x from ({boxes}))"
    far = f"{seg_sql('111320.0', 'ax', 'ay', 'bx', 'by_')[1]} - 360.0/{2**z}*111320*cos(radians(ay))/2"
    tried = ", ".join(f"({k}, {r!r}e0)" for k, r in enumerate(routes.radii(radius)))
    last = len(routes.radii(radius)) - 1
    near = f"(select {key}, x, y, min(far) as far from (select *, {far} as far from (select *, {lng} as lng, {lat} as lat from ({cells}))) group by all)"
    each = f"(select *, count(*) over (partition by {key}, k) as c from {near} n join (values {tried}) t(k, r) on n.far <= t.r)"
    return f"(select {key}, cast({z} as int) as z, cast(x as int) as x, cast(y as int) as y from {each} qualify k = min(case when c <= {cap} or k = {last} then k end) over (partition by {key}))"


def at_distance(source: str, key: str, metres: str, route) -> str:
    """(key, lng, lat) of the points `metres` along a route."""
    at = lambda a, b: f"{a} + (case when n=0 then 0 else (m_at-before)/n end)*({b}-{a})"
    end = route[-1]
    return f"(select {key}, coalesce(arg_min({at('ax', 'bx')}, i), {end[0]!r}) as lng, coalesce(arg_min({at('ay', 'by_')}, i), {end[1]!r}) as lat from (select *, {metres} as m_at from {source}) left join {values(routes.segments(route, routes.planar))} on m_at <= before+n group by {key})"
