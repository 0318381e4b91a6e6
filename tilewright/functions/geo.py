"""Geometry as column expressions; points are longitude and latitude columns in degrees, lengths metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius, and metres a degree where a plain factor is used.
R = 6371008.8
DEGREE_M = 111_320.0


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * R) * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def bearing_deg(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    d = F.radians(lng2 - lng1)
    a, b = F.radians(lat1), F.radians(lat2)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    """b - a in (-180, 180]."""
    d = F.pmod(b - a + 540, F.lit(360.0)) - 180
    return F.when(d == -180, F.lit(180.0)).otherwise(d)


def destination(lng: Column, lat: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    d, b, p = metres / R, F.radians(bearing), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    x = F.radians(lng) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(x), F.degrees(q)


def to_xy(lng: Column, lat: Column, ref_lng: Column, ref_lat: Column) -> tuple[Column, Column]:
    """Metres east and north of a reference point."""
    return F.radians(lng - ref_lng) * R * F.cos(F.radians(ref_lat)), F.radians(lat - ref_lat) * R


def segment_projection(lng: Column, lat: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(share t of the segment, distance) of the nearest point of segment a-b, in the plane at the point's latitude."""
    k = F.cos(F.radians(lat))
    dx, dy = F.radians(bx - ax) * k * R, F.radians(by - ay) * R
    px, py = F.radians(lng - ax) * k * R, F.radians(lat - ay) * R
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * dx + py * dy) / n))).otherwise(F.lit(0.0))
    return t, F.hypot(px - t * dx, py - t * dy)


def point_segment_m(lng: Column, lat: Column, ax: Column, ay: Column, bx: Column, by: Column, k: Column | None = None) -> Column:
    """Distance to a segment with the plain degree factor; k is the cosine of the point's latitude, where it is at hand."""
    k = F.cos(F.radians(lat)) if k is None else k
    dx, dy = (bx - ax) * k * DEGREE_M, (by - ay) * DEGREE_M
    px, py = (lng - ax) * k * DEGREE_M, (lat - ay) * DEGREE_M
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * dx + py * dy) / n))).otherwise(F.lit(0.0))
    return F.hypot(px - t * dx, py - t * dy)


def planar_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Equirectangular length with the first point's latitude."""
    return F.hypot(F.radians(lng2 - lng1) * F.cos(F.radians(lat1)), F.radians(lat2 - lat1)) * R


def pad_bbox(min_lng: Column, min_lat: Column, max_lng: Column, max_lat: Column, metres: Column) -> tuple[Column, Column, Column, Column]:
    d_lat = F.degrees(metres / R)
    d_lng = d_lat / F.greatest(F.lit(0.05), F.cos(F.radians((min_lat + max_lat) / 2)))
    return min_lng - d_lng, min_lat - d_lat, max_lng + d_lng, max_lat + d_lat


def circle(lng: Column, lat: Column, radius: Column, sides: int = 24) -> Column:
    """A closed ring of points around a point, the radius capped at 300 m."""
    r = F.least(radius, F.lit(300.0))
    k = F.greatest(F.lit(0.1), F.cos(F.radians(lat)))
    steps = F.sequence(F.lit(0), F.lit(sides))
    turn = lambda i: F.radians((i % sides) * (360.0 / sides))
    return F.transform(steps, lambda i: F.struct((lng + r * F.cos(turn(i)) / (DEGREE_M * k)).alias("lng"), (lat + r * F.sin(turn(i)) / DEGREE_M).alias("lat")))


def segment_bbox_m(ax: Column, ay: Column, bx: Column, by: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Distance of a segment's box from a box (min lng, min lat, max lng, max lat); 0 where they meet."""
    x0, y0, x1, y1 = box
    d_lat = F.greatest(y0 - F.greatest(ay, by), F.least(ay, by) - y1, F.lit(0.0))
    d_lng = F.greatest(x0 - F.greatest(ax, bx), F.least(ax, bx) - x1, F.lit(0.0))
    mid = (F.greatest(y0, F.least(ay, by)) + F.least(y1, F.greatest(ay, by))) / 2
    return F.hypot(F.radians(d_lat) * R, F.radians(d_lng) * R * F.cos(F.radians(mid)))
