"""The navigation engine on streams of fixes: one transition, driven by batches or by Structured Streaming."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tilewright.functions.geo import R
from tilewright.operators import greedy
from tilewright.operators.routes import Route, deviation, off_threshold, segments

STATE = "off_count int, last_reroute_ms long, arrived boolean"
OUTPUT = "trip_id long, event_id long, along_m double, dist_m double, off boolean, off_count int, arrived boolean, arrived_now boolean, reroute boolean"
START = (0, None, False)
#: A route's segments, as routes.segments() has them.
Legs = list[tuple[int, float, float, float, float, float, float]]


def project(lng: float, lat: float, legs: Legs) -> tuple[float, float]:
    """(distance, metres along) of the nearest segment, the first of equals."""
    best = None
    k = math.cos(math.radians(lat))
    for _, ax, ay, bx, by, before, n in legs:
        dx, dy = math.radians(bx - ax) * k * R, math.radians(by - ay) * R
        px, py = math.radians(lng - ax) * k * R, math.radians(lat - ay) * R
        size = dx * dx + dy * dy
        t = max(0.0, min(1.0, (px * dx + py * dy) / size)) if size else 0.0
        d = math.hypot(px - t * dx, py - t * dy)
        if best is None or d < best[0]:
            best = d, before + t * n
    return best


def step(state: tuple, fix, legs: Legs, cooldown_ms: int = 15_000) -> tuple[tuple, tuple]:
    """The next state and the output row of a fix (event_id, ts_ms, lng, lat, accuracy). Time is the fix's own."""
    off_count, last, arrived = state
    dist, along = project(fix.lng, fix.lat, legs)
    total = legs[-1][-2] + legs[-1][-1]
    along = max(0.0, min(along, total))
    limit = max(35.0, fix.accuracy * 1.8)
    off = dist > limit
    off_count = off_count + 1 if off else max(0, off_count - 1)
    here = total - along < 25
    now = here and not arrived
    reroute = (off_count >= 2 or off and dist > 4 * limit) and not here and (last is None or fix.ts_ms - last > cooldown_ms)
    return (off_count, fix.ts_ms if reroute else last, arrived or here), (int(fix.trip_id), int(fix.event_id), along, dist, off, off_count, here, now, reroute)


def fold(rows: pd.DataFrame, route: Route, state: tuple = START, cooldown_ms: int = 15_000) -> tuple[tuple, pd.DataFrame]:
    out, legs = [], segments(route)
    for fix in rows.sort_values(["ts_ms", "event_id"]).itertuples(index=False):
        state, row = step(state, fix, legs, cooldown_ms)
        out.append(row)
    return state, pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def batch(fixes: DataFrame, route: Route, cooldown_ms: int = 15_000) -> DataFrame:
    """Snapshots of all fixes (trip_id, event_id, ts_ms, lng, lat, accuracy), trip by trip."""
    return fixes.groupBy("trip_id").applyInPandas(lambda rows: fold(rows, route, START, cooldown_ms)[1], OUTPUT)


def snapshots(fixes: DataFrame, route: Route, cooldown_ms: int = 15_000) -> DataFrame:
    """batch() without a fold: the counter and the first arrival by windows, and the reroutes, which depend on the last one,
    by pointers from each fix that would reroute to the next that may."""
    w = Window.partitionBy("trip_id").orderBy("ts_ms", "event_id")
    total = sum(leg[-1] for leg in segments(route))
    rows = deviation(fixes, route, "trip_id", ("ts_ms", "event_id")).withColumn("_n", F.row_number().over(w))
    along = F.greatest(F.lit(0.0), F.least(F.col("along_m"), F.lit(total)))
    rows = rows.withColumn("along_m", along).withColumn("arrived", total - F.col("along_m") < 25).withColumn("_before", F.sum(F.col("arrived").cast("int")).over(w))
    limit = off_threshold(F.col("accuracy"))
    wanted = ((F.col("off_count") >= 2) | F.col("off") & (F.col("dist_m") > 4 * limit)) & ~F.col("arrived")
    rows = rows.select("trip_id", "event_id", "ts_ms", "along_m", "dist_m", "off", F.col("off_count").cast("int").alias("off_count"), "arrived", (F.col("arrived") & (F.col("_before") == 1)).alias("arrived_now"), wanted.alias("_wanted"), "_n").checkpoint()
    asked = rows.where("_wanted").select("trip_id", "ts_ms", F.col("_n").alias("at"))
    go = greedy.counting(asked, "trip_id", ["ts_ms", "at"], F.floor(F.col("ts_ms") / (cooldown_ms * greedy.FAN)), cooldown_ms + 1)
    return rows.join(go.select("trip_id", F.col("at").alias("_n"), F.lit(True).alias("reroute")), ["trip_id", "_n"], "left").select(*[c.split()[0] for c in OUTPUT.split(", ")][:-1], F.coalesce("reroute", F.lit(False)).alias("reroute"))


def stream(fixes: DataFrame, route: Route, cooldown_ms: int = 15_000, forget_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """The same on a stream. Fixes of a trip must arrive in order from batch to batch; inside one they are sorted.

    A trip without fixes for forget_ms of processing time is forgotten, so that state doesn't grow for ever."""

    def update(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = START
        if state.exists:
            off_count, last, arrived = state.get
            now = off_count, None if last < 0 else last, arrived
        for rows in [pd.concat(list(pieces))]:
            now, out = fold(rows, route, now, cooldown_ms)
            yield out
        state.update((now[0], -1 if now[1] is None else int(now[1]), now[2]))
        state.setTimeoutDuration(forget_ms)

    return fixes.groupBy("trip_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
