"""Queries over whole tables against brute force, under the names with and without _whole."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_spatial import brute
from tilewright import registry
from tilewright.derive import derived
from tilewright.functions import lookups
from tilewright.operators import routes
from tilewright.plans.routes import ROUTE

SF = "/root/testdata/sf0.01"


def got(spark, name):
    return registry.QUERIES[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def fixes(spark):
    return derived(spark, SF, "fixes").toPandas()


@pytest.fixture(scope="module")
def ways(spark):
    return derived(spark, SF, "ways").toPandas()


def test_vertex_join(spark, fixes):
    out = got(spark, "jon1_vertex_join_whole").set_index("event_id")["v"]
    x, y = (np.floor(fixes[c] * 32768 + 0.5).astype("int64") for c in ("lng", "lat"))
    assert out.to_dict() == dict(zip(fixes["event_id"], (x + 8388608) * 8388608 + y + 4194304, strict=True))


def test_nearest_node(spark, fixes):
    nodes = derived(spark, SF, "places").where("kind <> 'poi'").toPandas().sort_values("id").reset_index(drop=True)
    out = {r.id: (r.node, r.m) for r in got(spark, "jon5_nearest_node_whole").itertuples()}
    x, y, rank = np.radians(nodes["lng"].to_numpy()), np.radians(nodes["lat"].to_numpy()), nodes["boost"].to_numpy()
    want = {}
    for f in fixes.itertuples():
        a, b = math.radians(f.lng), math.radians(f.lat)
        m = 2 * 6371008.8 * np.arcsin(np.sqrt(np.sin((y - b) / 2) ** 2 + math.cos(b) * np.cos(y) * np.sin((x - a) / 2) ** 2))
        far = m > 150
        i = np.lexsort((m, np.where(far, 0, -rank), far))[0]
        if m[i] <= 5000:
            want[f.event_id] = (nodes["id"][i], m[i])
    assert out.keys() == want.keys() and max(out) >= 400
    assert all(out[k][0] == v[0] and abs(out[k][1] - v[1]) < 1 for k, v in want.items())


def test_circles_and_boxes(spark, fixes):
    out = got(spark, "geo17_circle_whole")
    assert out.groupby("event_id").size().to_dict() == dict.fromkeys(fixes["event_id"], 25)
    f = out.merge(fixes, on="event_id", suffixes=("", "_at"))
    north = f["lat_at"] + np.minimum(f["accuracy"], 300) / 111320 * np.sin(np.radians(f["i"] % 24 * 15))
    assert (abs(f["lat"] - north) < 1e-7).all()
    out = got(spark, "til6_tiles_in_bbox_whole")
    x = lambda lng: np.floor((lng + 180) / 360 * 8192).astype(int)
    y = lambda lat: np.floor((1 - np.log(np.tan(np.radians(lat)) + 1 / np.cos(np.radians(lat))) / np.pi) / 2 * 8192).astype(int)
    want = {(e, i, j) for e, a, b, c, d in zip(fixes["event_id"], x(fixes["lng"] - 0.05), x(fixes["lng"] + 0.05), y(fixes["lat"] + 0.05), y(fixes["lat"] - 0.05), strict=True) for i in range(a, b + 1) for j in range(c, d + 1)}
    assert set(out.itertuples(index=False, name=None)) == want and len(out) == len(want)


def directed(ways):
    for w in ways.itertuples():
        cost = 0.1 / lookups.CLASS_SPEED.get(w.cls, 30) * 3600
        if w.oneway >= 0:
            yield w.f, w.t, cost
        if w.oneway <= 0:
            yield w.t, w.f, cost


def test_paths_and_steps(spark, ways):
    want = brute(list(directed(ways)), 0)
    out = got(spark, "grf8_shortest_paths_whole").set_index("id")["cost"].to_dict()
    assert out.keys() == want.keys() and max(out) >= 200 and all(abs(out[k] - want[k]) < 1e-3 for k in want)
    steps = got(spark, "grf14_steps")
    assert set(steps["id"]) == want.keys() - {0}
    assert all(abs(s - want[k]) < 1e-3 for k, s in steps.groupby("id")["duration_s"].sum().items())


def test_components(spark, ways):
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in zip(ways["f"], ways["t"], strict=True):
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    sizes = pd.Series({i: top(i) for i in list(up)})
    out = got(spark, "grf10_components_whole")
    assert dict(zip(out["node"], out["component"], strict=True)) == sizes.to_dict()
    assert out["size"].tolist() == out["component"].map(sizes.value_counts()).tolist()


def test_orders(spark):
    places = derived(spark, SF, "places").toPandas()
    out = got(spark, "srt1_index_order_whole")
    assert list(out.itertuples(index=False, name=None)) == [(i, n) for n, i in sorted((n.lower(), i) for i, n in zip(places["id"], places["name"], strict=True))]
    tiles = derived(spark, SF, "tiles").where("tier = 'smart'").toPandas()
    assert got(spark, "srt5_lru_order_whole")["tile_id"].tolist() == tiles.sort_values(["last_access", "tile_id"])["tile_id"].tolist()


def test_spoken_utterances(spark, fixes, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(40).toPandas()
    events["user_id"], events["event_id"] = 1, range(40)
    events["ts"] = [pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=i) for i in range(40)]
    spark.createDataFrame(events).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    out = registry.QUERIES["str8_throttle_whole"](spark, str(tmp_path)).collect()
    assert sorted(r.event_id for r in out) == list(range(0, 40, 2))


def test_milestones(spark):
    n = registry.QUERIES["str1_navigation"](spark, SF).toPandas()
    at = lambda r: next((m for m in ((200, 800, 2000) if r.next_step < 3 else (300,)) if r.to_step_m <= m), None)
    want = {(r.trip_id, r.next_step, at(r)) for r in n[~n["off"]].itertuples() if at(r)}
    assert set(got(spark, "str7_voice_milestones_whole").itertuples(index=False, name=None)) == want
    assert 3 in {s for _, s, _ in want}


def center(x, y, z):
    north = [math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / 2**z)))) for v in (y, y + 1)]
    return (x + 0.5) / 2**z * 360 - 180, sum(north) / 2


def nearest(lng, lat):
    """(metres off the route, metres along it)"""
    out = []
    for _, ax, ay, bx, by, before, n in routes.segments(ROUTE):
        k = math.cos(math.radians(lat))
        dx, dy, px, py = ((bx - ax) * k, by - ay, (lng - ax) * k, lat - ay)
        t = min(1.0, max(0.0, (px * dx + py * dy) / (dx * dx + dy * dy)))
        out.append((math.hypot(px - t * dx, py - t * dy) * 111_320, before + t * n))
    return min(out)


def test_protection(spark):
    tiles = derived(spark, SF, "tiles").toPandas()
    near = {(x, y): nearest(*center(x, y, 13)) for x, y in set(zip(tiles["x"], tiles["y"], strict=True))}
    safe = [bool(p) and near[x, y][0] <= 2000 and near[x, y][1] >= 45_000 for x, y, p in zip(tiles["x"], tiles["y"], tiles["pinned_by"].notna(), strict=True)]
    assert any(safe) and set(got(spark, "jon8_protected")["tile_id"]) == set(tiles["tile_id"][safe])
    smart = tiles[tiles["tier"] == "smart"]
    left, want = smart["size"].sum(), set()
    for r in smart[~pd.Series(safe, index=tiles.index)[smart.index]].sort_values(["last_access", "tile_id"]).itertuples():
        if left <= 90_000_000:
            break
        want.add(r.tile_id)
        left -= r.size
    assert want and set(got(spark, "cor4_plan_eviction_whole")["tile_id"]) == want


def test_corridor_plan(spark):
    out = got(spark, "cor2_overview")
    assert sorted(set(out["z"])) == list(range(6, 15)) and not out.duplicated().any()
    own = ["route_id", "x", "y"]
    assert {tuple(t) for t in out[out["z"] == 13][own].to_numpy()} == {tuple(t) for t in got(spark, "jon7_corridor")[own].to_numpy()}
    fine = {tuple(t) for t in out[out["z"] == 14][own].to_numpy()}
    for route, points in derived(spark, SF, "trips").toPandas().sort_values(["ts", "event_id"]).groupby("route_id"):
        for lng, lat in points[["lng", "lat"]].to_numpy()[[0, -1]] if len(points) > 1 else []:
            x = math.floor((lng + 180) / 360 * 2**14)
            y = math.floor((1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * 2**14)
            assert (route, x, y) in fine
