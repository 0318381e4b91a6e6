"""Tables of road classes, places and texts, and their lookups.

All are fixed values of the map data's classes; a lookup is a map literal in the plan."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speed by road class, km/h.
CLASS_SPEED = {
    "motorway": 110, "motorway_link": 60, "trunk": 90, "trunk_link": 50, "primary": 65, "primary_link": 45, "secondary": 55, "secondary_link": 40,
    "tertiary": 45, "tertiary_link": 35, "minor": 40, "unclassified": 45, "residential": 30, "living_street": 15, "service": 20, "track": 25,
    "pedestrian": 5, "footway": 5, "path": 5, "cycleway": 15, "steps": 3,
}
DEFAULT_SPEED = 30
# Speed by mode, km/h.
MODE_SPEED = {"car": 50, "bicycle": 15, "foot": 5}
# Modes that may use a class.
CLASS_MODES = {
    "motorway": ["car"], "motorway_link": ["car"], "trunk": ["car"], "trunk_link": ["car"],
    "primary": ["car", "bicycle"], "primary_link": ["car", "bicycle"], "secondary": ["car", "bicycle"], "secondary_link": ["car", "bicycle"],
    "tertiary": ["car", "bicycle"], "tertiary_link": ["car", "bicycle"],
    "minor": ["car", "bicycle", "foot"], "unclassified": ["car", "bicycle", "foot"], "residential": ["car", "bicycle", "foot"],
    "living_street": ["car", "bicycle", "foot"], "service": ["car", "bicycle", "foot"], "track": ["car", "bicycle", "foot"],
    "pedestrian": ["foot"], "footway": ["foot"], "path": ["bicycle", "foot"], "cycleway": ["bicycle"], "steps": ["foot"],
}
# How much a class matters when a point snaps to a road.
CLASS_RANK = {"motorway": 10, "trunk": 9, "primary": 8, "secondary": 7, "tertiary": 6, "residential": 5, "unclassified": 5, "minor": 5, "living_street": 3, "service": 1, "track": 1}
# What a road without a name is called.
CLASS_PHRASE = {
    "motorway": "the motorway", "motorway_link": "the ramp", "trunk": "the trunk road", "trunk_link": "the ramp", "primary": "the primary road", "primary_link": "the ramp",
    "secondary": "the secondary road", "secondary_link": "the ramp", "tertiary": "the tertiary road", "tertiary_link": "the ramp",
    "unclassified": "the road", "residential": "the street", "living_street": "the street", "service": "the service road", "track": "the track",
}
# Search boost and kind by place class.
PLACE_BOOST = {"city": 120, "town": 90, "village": 70, "hamlet": 55, "suburb": 60, "neighbourhood": 50, "borough": 65, "municipality": 75}
PLACE_KIND = {"city": "city", "town": "town", "village": "village", "hamlet": "hamlet", "suburb": "suburb", "neighbourhood": "suburb", "borough": "suburb"}
# Degrees by which an arrow turns.
ARROW = {"uturn": 160, "sharp right": 110, "sharp left": -110, "right": 85, "left": -85, "slight right": 35, "slight left": -35}


def lookup(table: dict, key: Column, default=None) -> Column:
    literal = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    found = F.when(key.isNotNull(), F.try_element_at(literal, key))
    return found if default is None else F.coalesce(found, F.lit(default))


def class_speed(cls: Column) -> Column:
    return lookup(CLASS_SPEED, cls, DEFAULT_SPEED)


def class_rank(cls: Column) -> Column:
    return lookup(CLASS_RANK, cls, 0)


def is_accessible(cls: Column, mode: str) -> Column:
    return cls.isin([c for c, modes in CLASS_MODES.items() if mode in modes])


def edge_weight(length_m: Column, cls: Column, ramp: Column, roundabout: Column) -> Column:
    """Seconds on an edge."""
    return length_m / 1000 / class_speed(cls) * 3600 * F.when(ramp, 1.1).otherwise(1.0) * F.when(roundabout, 1.2).otherwise(1.0)


def mode_weight(length_m: Column, cls: Column, mode: str) -> Column:
    return length_m / 1000 / F.least(class_speed(cls), F.lit(MODE_SPEED[mode])) * 3600


def parse_oneway(value: Column) -> Column:
    v = F.lower(value.cast("string"))
    return F.when(v.isin("1", "true", "yes"), 1).when(v == "-1", -1).otherwise(0)


def stitch_radius(z: Column) -> Column:
    """Metres within which dead ends are joined."""
    return F.when(z >= 14, 15).when(z == 13, 80).when(z == 12, 200).when(z == 11, 400).when(z == 10, 800).otherwise(1200)


def modifier_for(delta: Column) -> Column:
    a, right = F.abs(delta), delta > 0
    return (
        F.when(a >= 160, "uturn")
        .when(a >= 120, F.when(right, "sharp right").otherwise("sharp left"))
        .when(a >= 45, F.when(right, "right").otherwise("left"))
        .when(a >= 20, F.when(right, "slight right").otherwise("slight left"))
        .otherwise("straight")
    )


def theme(hour: Column) -> Column:
    return F.when((hour >= 7) & (hour < 19), "day").otherwise("night")


def interpolate(z: Column, stops: list[tuple[float, float]], base: float = 1.0) -> Column:
    """A map style's value at a zoom: the ends' values beyond the stops, between them linear (base 1) or exponential."""
    out = F.lit(float(stops[-1][1]))
    for (z0, v0), (z1, v1) in reversed(list(zip(stops, stops[1:], strict=False))):
        share = (z - z0) / (z1 - z0) if base == 1.0 else (F.pow(F.lit(base), z - z0) - 1) / (base ** (z1 - z0) - 1)
        out = F.when(z < z1, v0 + (v1 - v0) * share).otherwise(out)
    return F.when(z <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


def style_layer(cls: Column, ramp: Column, z: Column) -> Column:
    """Which road layer of the map draws a class at a zoom; null where none does."""
    return (
        F.when(F.coalesce(ramp, F.lit(False)) & (z >= 12), "link")
        .when(cls == "motorway", "motorway")
        .when(cls.isin("trunk", "primary") & (z >= 7), "major")
        .when(cls.isin("secondary", "tertiary") & (z >= 9), "secondary")
        .when(cls.isin("minor", "residential", "unclassified", "living_street", "service") & (z >= 12), "minor")
        .when(cls.isin("track", "path", "footway", "cycleway", "steps", "pedestrian") & (z >= 14), "path")
    )
