"""Web Mercator tile arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LAT = 85.05112878
EQUATOR_M = 40075016.7


def n_tiles(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def world_x(lng: Column) -> Column:
    """Share of the world's width from the west."""
    return (lng + 180) / 360


def world_y(lat: Column) -> Column:
    """Share of the projected world's height from the north."""
    p = F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat)))
    return (1 - F.ln(F.tan(p) + 1 / F.cos(p)) / F.pi()) / 2


def tile_x(lng: Column, z: Column) -> Column:
    return F.floor(world_x(lng) * n_tiles(z)).cast("int")


def tile_y(lat: Column, z: Column) -> Column:
    return F.floor(world_y(lat) * n_tiles(z)).cast("int")


def tile_west(x: Column, z: Column) -> Column:
    return x / n_tiles(z) * 360 - 180


def tile_north(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / n_tiles(z)))))


def tile_center(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return (tile_west(x, z) + tile_west(x + 1, z)) / 2, (tile_north(y, z) + tile_north(y + 1, z)) / 2


def tile_key(source: Column, z: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("/", source, z.cast("string"), x.cast("string"), y.cast("string"))


def parse_tile_key(key: Column) -> tuple[Column, Column, Column, Column]:
    part = F.split(key, "/")
    return part[0], part[1].cast("int"), part[2].cast("int"), part[3].cast("int")


def tile_width_m(z: Column, lat: Column) -> Column:
    return EQUATOR_M * F.cos(F.radians(lat)) / n_tiles(z)


def metres_per_pixel(z: Column, lat: Column) -> Column:
    return 156543.03392 * F.cos(F.radians(lat)) / n_tiles(z)


def tiles_in_bbox(min_lng: Column, min_lat: Column, max_lng: Column, max_lat: Column, z: Column) -> Column:
    """Array of (x, y), x first, x wrapped round the world and y within it."""
    xs = F.sequence(tile_x(min_lng, z), tile_x(max_lng, z))
    ys = F.sequence(tile_y(max_lat, z), tile_y(min_lat, z))
    n = n_tiles(z).cast("int")
    return F.flatten(F.transform(xs, lambda x: F.transform(F.filter(ys, lambda y: (y >= 0) & (y < n)), lambda y: F.struct(F.pmod(x, n).alias("x"), y.alias("y")))))


def local_to_lnglat(px: Column, py: Column, x: Column, y: Column, z: Column, extent: Column, y_down: bool = False) -> tuple[Column, Column]:
    """Tile coordinates to degrees, linear from the south-west corner; y_down takes them from the north-west one."""
    return box_to_lnglat(px, py, tile_box(x, y, z), extent, y_down)


def tile_box(x: Column, y: Column, z: Column) -> Column:
    """A tile's sides in degrees."""
    return F.struct(tile_west(x, z).alias("west"), tile_west(x + 1, z).alias("east"), tile_north(y, z).alias("north"), tile_north(y + 1, z).alias("south"))


def box_to_lnglat(px: Column, py: Column, box: Column, extent: Column, y_down: bool = False) -> tuple[Column, Column]:
    """local_to_lnglat() with the tile's sides as tile_box() gives them, which many points of a row may share."""
    height, share = box["north"] - box["south"], py / extent
    return box["west"] + px / extent * (box["east"] - box["west"]), box["north"] - share * height if y_down else box["south"] + share * height


def fill_url(template: Column, z: Column, x: Column, y: Column) -> Column:
    return F.replace(F.replace(F.replace(template, F.lit("{z}"), z.cast("string")), F.lit("{x}"), x.cast("string")), F.lit("{y}"), y.cast("string"))
