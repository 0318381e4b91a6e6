"""Rows that count one after the other, against a plain loop; corridors, points and slices of many routes against one route's."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.operators import greedy, routes
from tilewright.plans.graph import checkpointed
from tilewright.streaming import navigation


def rows_of(seed, keys=4, most=700):
    rng, out = random.Random(seed), []
    for k in range(keys):
        t = 0
        for i in range(rng.randrange(most) if k else most):
            t += rng.choice((0, 0, 1, 5, 40))
            out.append((k if k < 3 else None, t, i, rng.uniform(0, 400), rng.random() < 0.05))
    return out


def loop(rows, gap, least=None, always=False):
    out = []
    for k in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            far = last is not None and r[1] - last[1] >= gap and (least is None or abs(r[3] - last[3]) >= least)
            if last is None or far or always and r[4]:
                out.append(r)
                last = r
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan", [4, 64])
def test_against_a_loop(spark, fan, monkeypatch):
    monkeypatch.setattr(greedy, "FAN", fan)
    checkpointed(spark)
    rows = [r for r in rows_of(fan, most=300 if fan > 4 else 60) if r[0] is not None]
    df = spark.createDataFrame(rows, "k long, t long, i long, x double, a boolean")
    bucket = F.floor(F.col("t") / 500)
    for gap, least, always in ((30, None, True), (60, 200.0, False), (10_000_000, None, True)):
        out = greedy.counting(df, "k", ["t", "i"], bucket, gap, *(("x", least) if least else ()), **({"always": F.col("a")} if always else {}))
        assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=repr) == loop(rows, gap, least, always)
    assert greedy.counting(df.limit(0), "k", ["t", "i"], bucket, 5).collect() == []


def test_one_key_over_many_tasks(spark):
    """The places in a key come from buckets, so that no window or group holds a whole key."""
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("t"), "id")
    out = greedy.numbered(df, "k", ["t", "id"], F.floor(F.col("t") / 500))
    assert out.where("n <> id").count() == 0
    checkpointed(spark)
    got = sorted(r.t for r in greedy.counting(df, "k", ["t", "id"], F.floor(F.col("t") / 500), 100).collect())
    assert got == list(range(0, 15_000, 102))


def test_snapshots_equal_the_fold(spark):
    rng = random.Random(2)
    route = [(-77.0, 40.0), (-76.8, 40.05), (-76.5, 40.2)]
    rows, t = [], 0
    for i in range(300):
        t += rng.choice((1000, 4000, 20_000))
        at = i % 150 / 149
        rows.append((i // 150, i, t, -77.0 + 0.5 * at, 40.0 + 0.2 * at * at + rng.choice((0, 0, 0.003, 0.02)), 5.0 + i % 4 * 10))
    df = spark.createDataFrame(rows, "trip_id long, event_id long, ts_ms long, lng double, lat double, accuracy double")
    checkpointed(spark)
    near = lambda r: (r.trip_id, r.event_id, round(r.along_m, 3), round(r.dist_m, 3), r.off, r.off_count, r.arrived, r.arrived_now, r.reroute)
    a, b = navigation.snapshots(df, route), navigation.batch(df, route)
    assert a.schema.simpleString() == b.schema.simpleString()
    got, want = sorted(map(near, a.collect())), sorted(map(near, b.collect()))
    assert got == want and 5 < sum(r[-1] for r in want) < 200


def lines():
    rng = random.Random(4)
    out = {1: [(-77.0, 40.0), (-76.9, 40.02)], 2: [(-77.0, 40.0), (-77.0, 40.0), (-76.7, 40.1), (-76.7, 40.1), (-76.75, 40.0)]}
    for k in range(3, 9):
        out[k] = [(-77 + rng.random() * 0.5, 40 + rng.random() * 0.3) for _ in range(rng.randrange(2, 6))]
    return out


@pytest.fixture(scope="module")
def segs(spark):
    points = [(k, i, *p) for k, line in lines().items() for i, p in enumerate(line)] + [(99, 0, -77.0, 40.0)]
    rows = routes.legs(spark.createDataFrame(points, "route_id long, o int, lng double, lat double"), "route_id", ["o"])
    return spark.createDataFrame(rows.collect(), rows.schema)


def one(spark, line):
    return spark.createDataFrame(routes.segments(line), "i int, ax double, ay double, bx double, by double, before double, n double")


def test_corridors_equal_single_ones(spark, segs):
    for z, radius, cap in ((13, 2000.0, 1400), (13, 5000.0, 40), (12, 9000.0, 10)):
        got = routes.corridors(segs, "route_id", z, radius, cap).collect()
        for k, line in lines().items():
            want, its = routes.corridor_within(one(spark, line), z, radius, cap)
            mine = [r for r in got if r.route_id == k]
            assert {(r.x, r.y) for r in mine} == {(r.x, r.y) for r in want.collect()} and len({(r.x, r.y) for r in mine}) == len(mine)
            assert {r.radius for r in mine} == {its}
        assert not any(r.route_id == 99 for r in got)
    assert len({r.radius for r in routes.corridors(segs, "route_id", 13, 5000.0, 40).collect()}) > 1


def at(line, m):
    for _, ax, ay, bx, by, before, n in routes.segments(line, routes.planar):
        if before + n >= m:
            t = (m - before) / n if n else 0.0
            return ax + t * (bx - ax), ay + t * (by - ay)
    return line[-1]


def test_points_along_lines(segs):
    got = routes.spaced(segs, F.col("total") / 37, F.lit(37), "route_id").collect()
    for k, line in lines().items():
        total = sum(s[-1] for s in routes.segments(line))
        mine = {r.k: (r.lng, r.lat) for r in got if r.route_id == k}
        assert sorted(mine) == list(range(38))
        assert all(math.dist(mine[i], at(line, i * (total / 37))) < 1e-9 for i in mine)
    beyond = [r for r in routes.spaced(segs, F.lit(9000.0), F.lit(30), "route_id").collect() if r.route_id == 1]
    assert len(beyond) == 31 and all((r.lng, r.lat) == (-76.9, 40.02) for r in beyond if r.k > 1)


def test_clipped_lines(segs):
    for a, b in ((-500.0, 2500.0), (4000.0, 21_000.0), (0.0, 1e9), (1e9, 2e9)):
        got = routes.clipped(segs, F.lit(a), F.lit(b)).orderBy("route_id", "i").collect()
        for k, line in lines().items():
            mine = [r for r in got if r.route_id == k]
            want = routes.sliced(line, a, b)
            points = [(mine[0].ax, mine[0].ay), *[(r.bx, r.by) for r in mine]] if mine else []
            assert len(points) == (len(want) if len(want) > 1 else 0) and all(math.dist(p, q) < 1e-9 for p, q in zip(points, want, strict=False))


def test_legs(segs):
    for k, line in lines().items():
        mine = segs.where(F.col("route_id") == k).orderBy("i").collect()
        assert [(r.ax, r.ay, r.bx, r.by) for r in mine] == [s[1:5] for s in routes.segments(line)]
        assert abs(mine[0].total - sum(s[-1] for s in routes.segments(line))) < 1e-6 and [r.last for r in mine] == [False] * (len(mine) - 1) + [True]
        assert all(abs(r.before - s[5]) < 1e-6 and abs(r.n - s[6]) < 1e-6 for r, s in zip(mine, routes.segments(line, routes.planar), strict=True))
    assert geo.R > 6e6
