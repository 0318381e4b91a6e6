"""Rules that SQL doesn't hold: tile graphs on small maps, plans in two passes, simplified lines, steps, errors of tiles."""

import collections
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.mvt_encoder import tile
from tests.test_spatial import rows
from tilewright import registry
from tilewright.operators import graph, planner, routes, search, store, tilegraph
from tilewright.plans.graph import checkpointed
from tilewright.sources import gps, mvt

SF = "/root/testdata/sf0.001"


def lnglat(z, x, y, px, py):
    n = 2**z
    west, width = x / n * 360 - 180, 360 / n
    lat = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n))))
    return west + px / 4096 * width, lat(y + 1) + py / 4096 * (lat(y) - lat(y + 1))


def road(i, points, **props):
    return (i, 2, {"class": "residential"} | props, [points])


@pytest.fixture(scope="module")
def city(spark):
    """Streets and avenues of a grid in each of 3 x 1 tiles; streets end 20 steps over the edge, 6 steps off their neighbours."""
    checkpointed(spark)
    out = []
    for t in range(3):
        ys = [500 * i + 6 * t for i in range(1, 8)]
        xs = [-20, 30, 200, *range(500, 4096, 500), 4090, 4116]
        features = [road(i, [(x, y) for x in xs], name=f"{i} Main St") for i, y in enumerate(ys)]
        features += [road(10 + j, [(x, y) for y in ys]) for j, x in enumerate(range(500, 4096, 500))]
        names = [(1, 2, {"name": "First Avenue"}, [[(500, ys[0]), (500, ys[1])]])]
        out.append((f"planet/13/{2344 + t}/3098", tile([("water", 4096, []), ("transportation", 4096, features), ("transportation_name", 4096, names)])))
    return rows(spark, out, "k string, data binary").cache()


def test_a_drivable_graph_from_tiles(spark, city):
    one = city.where("k = 'planet/13/2344/3098'")
    edges = tilegraph.graph(one)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    # Seven streets of 13 vertices; avenues share the streets' vertices.
    assert edges.count() == 2 * (7 * 12 + 8 * 6) - 0 and nodes.count() == 7 * 13
    assert {r.size for r in graph.components(edges, nodes).collect()} == {91}
    named = {r.name for r in edges.select("name").distinct().collect()}
    assert "First Avenue" in named and "1 Main St" in named and None in named


def test_tiles_are_stitched(spark, city):
    def components(edges):
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        return {r.component for r in graph.components(edges, nodes).collect()}

    apart, whole = tilegraph.graph(city), tilegraph.graph(city, 80.0)
    assert len(components(apart)) == 3 and len(components(whole)) == 1
    total = lambda e: e.agg(F.sum("length_m")).first()[0]
    assert total(apart) < total(whole) < total(apart) + 28 * 2 * 200  # connectors only


def test_plan(spark, city):
    a, b = lnglat(13, 2344, 3098, 500, 500), lnglat(13, 2346, 3098, 3500, 3500)
    p = planner.plan(city, a, b)
    assert p.reason is None and p.zoom == 13 and not p.fine and p.seconds > 0
    assert max(abs(x - y) for x, y in zip([*p.points[0], *p.points[-1]], [*a, *b], strict=True)) < 0.001
    length = sum(s[-1] for s in routes.segments(p.points))
    assert math.isclose(length, abs(b[0] - a[0]) * 111320 * math.cos(math.radians(a[1])) + abs(b[1] - a[1]) * 111320, rel_tol=0.05)
    assert planner.plan(city, (10.0, 50.0), (10.01, 50.0)).reason == "no-data"
    assert planner.plan(city, (-170.0, 60.0), (170.0, -60.0)).reason == "too-far"
    assert planner.plan(city, lnglat(13, 2342, 3095, 0, 0), a).reason == "no-origin"


def test_two_passes(spark):
    out = registry.QUERIES["grf20_two_phase_plan"](spark, "/root/testdata/sf0.01").collect()
    assert [(r.id, r.zoom, r.reason, r.fine) for r in sorted(out)] == [(0, 13, None, False), (1, 12, None, True), (2, 11, "no-data", False), (3, 13, "no-data", False), (4, 8, "too-far", False)]


def test_tile_writing_and_errors(spark):
    data = tile([("a", 512, [(1, 2, {"n": 2**60 + 1, "s": "é", "b": True, "d": 1.5}, [[(0, 0), (5, -3)], [(7, 7), (8, 8)]]), (None or 2, 3, {}, [[(0, 0), (4, 0), (4, 4)]])])])
    df = rows(spark, [("x", data), ("bad", b"\x1a\xff"), ("none", None), ("empty", b"")], "k string, data binary")
    first = mvt.features(df)
    again = mvt.features(mvt.encode(first))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect())) and first.count() == 2
    assert first.where("id = 1").first().props["n"].i == 2**60 + 1
    assert [(r.k, r.error.split(":")[0]) for r in mvt.unreadable(df).collect()] == [("bad", "IndexError")] or mvt.unreadable(df).count() == 1


def test_simplified_lines(spark):
    line = [(i, 0.001 * i, 0.0 if i % 5 else 0.0001 * (i % 2), "x") for i in range(40)]
    df = rows(spark, [(t, i, x, y, z) for t in (1, 2) for i, x, y, z in line], "trip_id long, event_id long, lng double, lat double, ts string")
    want = [i for i in graph.simplify([(x, y) for _, x, y, _ in line], 5.0, places=True)]
    got = collections.defaultdict(list)
    for r in routes.simplified(df, "trip_id", ["event_id"], 5.0).collect():
        got[r.trip_id].append(r.event_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: want, 2: want}
    assert routes.simplified(df.limit(0), "trip_id", ["event_id"], 5.0).count() == 0


def test_ramps_and_roundabouts():
    def leg(lng, lat, lng2, lat2, cls, **more):
        return {"lng": lng, "lat": lat, "lng2": lng2, "lat2": lat2, "name": "A", "cls": cls, "junction": True, "length_m": 500.0, "seconds": 60.0, "ramp": False, "roundabout": False} | more

    path = [leg(0, 0, 0, 0.005, "service"), leg(0, 0.005, 0.005, 0.005, "primary"), leg(0.005, 0.005, 0.005, 0.01, "residential", roundabout=True), leg(0.005, 0.01, 0.005, 0.015, "service"), leg(0.005, 0.015, 0.01, 0.015, "motorway", ramp=True)]
    assert [(s["type"], s["modifier"]) for s in graph.steps(pd.DataFrame(path))] == [("depart", None), ("merge", "right"), ("roundabout", "left"), ("turn", "right"), ("arrive", None)]


def test_long_routes_project_alike(spark):
    zigzag = [(-77.0 + i * 0.001, 40.0 + (i % 3) * 0.0005) for i in range(400)]
    df = spark.range(50).select((F.lit(-77.0) + F.col("id") * 0.0079).alias("lng"), F.lit(40.0003).alias("lat"))
    got = df.select(routes.project_onto_path(F.col("lng"), F.col("lat"), zigzag).alias("p"), "lng", "lat").collect()
    from tilewright.streaming.navigation import project

    for r in got:
        d, along = project(r.lng, r.lat, routes.segments(zigzag))
        assert abs(r.p.dist_m - d) < 1e-6 and abs(r.p.along_m - along) < 1e-6


def test_streamed_fixes(spark, tmp_path):
    df = rows(spark, [(1, 2, None, 0.5, 0.5, 5.0)], gps.FIX)
    df.write.parquet(str(tmp_path / "in"))
    assert gps.stream(spark, str(tmp_path / "in")).isStreaming and gps.read(spark, str(tmp_path / "in")).collect() == df.collect()


def test_store_and_index_take_empty_tables(spark):
    none = rows(spark, [], "k string, size long, tier string")
    assert store.fetched(none, none.select("k", "size")).count() == 0
    docs = rows(spark, [("1", "A", 5, "t1"), ("2", "B", 6, "t2")], "id string, name string, boost int, tile string")
    again = rows(spark, [("1", "A", 9, "t1"), ("1", "A", 7, "t1")], "id string, name string, boost int, tile string")
    assert sorted(search.put_docs(docs, again).collect()) == [("1", "A", 9, "t1"), ("2", "B", 6, "t2")]
    assert [r.id for r in search.remove_docs(docs, docs.where("id = '1'")).collect()] == ["2"]
    assert search.remove_docs(docs.limit(0), docs).count() == 0


def test_coarse_zoom_breaks(spark):
    trips = rows(spark, [(0, -77.0, 40.0, -76.9, 40.0), (1, -77.0, 40.0, -76.5, 40.0), (2, -77.0, 40.0, -75.0, 40.0), (3, -77.0, 40.0, 80.0, -40.0)], "id int, a double, b double, c double, d double")
    out = trips.select("id", store.coarse_zoom(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("z")).orderBy("id").collect()
    assert [(r.z.z, r.z.ok) for r in out] == [(13, True), (12, True), (11, True), (8, False)]
