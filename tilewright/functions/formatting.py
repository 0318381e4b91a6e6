"""Distances, durations, sizes and instructions as text.

Halves round up (floor(x + 0.5)); one decimal is cut from the rounded number, so that a binary
fraction next to a half follows its exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.lookups import ARROW, CLASS_PHRASE, lookup


def whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long").cast("string")


def decimals(x: Column, n: int) -> Column:
    """x with n decimals."""
    scaled = F.floor(x * 10**n + 0.5).cast("long")
    return F.concat(F.floor(scaled / 10**n).cast("long").cast("string"), F.lit("."), F.lpad((scaled % 10**n).cast("string"), n, "0"))


def distance(m: Column, units: str = "metric") -> Column:
    if units == "imperial":
        feet, miles = m * 3.28084, m / 1609.344
        return F.when(feet < 528, F.concat((F.floor(feet / 10 + 0.5) * 10).cast("long").cast("string"), F.lit(" ft"))).when(miles < 10, F.concat(decimals(miles, 1), F.lit(" mi"))).otherwise(F.concat(whole(miles), F.lit(" mi")))
    km = m / 1000
    return F.when(m < 950, F.concat((F.floor(m / 10 + 0.5) * 10).cast("long").cast("string"), F.lit(" m"))).when(km < 10, F.concat(decimals(km, 1), F.lit(" km"))).otherwise(F.concat(whole(km), F.lit(" km")))


def duration(s: Column) -> Column:
    minutes = F.floor(s / 60 + 0.5).cast("long")
    hours, rest = F.floor(minutes / 60).cast("string"), minutes % 60
    return F.when(minutes < 1, "<1 min").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(rest == 0, F.concat(hours, F.lit(" h"))).otherwise(F.concat(hours, F.lit(" h "), rest.cast("string"), F.lit(" min")))


def eta(ts: Column, remaining_s: Column) -> Column:
    return F.date_format((ts.cast("timestamp").cast("double") + remaining_s).cast("timestamp"), "HH:mm")


def speed(mps: Column, units: str = "metric") -> Column:
    n, unit = (mps * 2.23694, " mph") if units == "imperial" else (mps * 3.6, " km/h")
    return F.when(mps.isNull(), "—").otherwise(F.concat(whole(n), F.lit(unit)))


def size(n: Column) -> Column:
    kb = n / 1024
    mb = kb / 1024
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(kb < 1024, F.concat(whole(kb), F.lit(" KB")))
        .when(mb < 10, F.concat(decimals(mb, 1), F.lit(" MB")))
        .when(mb < 1024, F.concat(whole(mb), F.lit(" MB")))
        .otherwise(F.concat(decimals(mb / 1024, 2), F.lit(" GB")))
    )


def _turn(modifier: Column, onto: Column) -> Column:
    m = F.coalesce(modifier, F.lit("straight"))
    return F.when(m == "straight", F.concat(F.lit("Continue straight"), onto)).when(m == "uturn", F.concat(F.lit("Make a U-turn"), onto)).otherwise(F.concat(F.lit("Turn "), m, onto))


def instruction(kind: Column, modifier: Column, name: Column, spoken: bool = False) -> Column:
    """What the display shows or the voice says for a step."""
    named = F.coalesce(name, F.lit("")) != ""
    after = lambda words: F.when(named, F.concat(F.lit(words), name)).otherwise("")
    onto = after(" onto ")
    depart = F.when(named, F.concat(F.lit("Continue on "), name)).otherwise("Begin the route") if spoken else F.concat(F.lit("Head out"), after(" on "))
    circle = F.when(named, F.concat(F.lit("At the roundabout, take the exit onto "), name)).otherwise("Enter the roundabout") if spoken else F.concat(F.lit("Enter the roundabout"), after(", exit onto "))
    return (
        F.when(kind == "depart", depart)
        .when(kind == "merge", F.concat(F.lit("Merge"), onto))
        .when(kind == "roundabout", circle)
        .when(kind == "continue", F.concat(F.lit("Continue"), after(" on ")))
        .when(kind == "arrive", "You have arrived" if spoken else "Arrive at your destination")
        .otherwise(_turn(modifier, onto))
    )


def arrow_rotation(modifier: Column) -> Column:
    return lookup(ARROW, modifier, 0)


def road_name(name: Column, cls: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(lookup(CLASS_PHRASE, cls, "the road"))
