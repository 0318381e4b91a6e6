"""Properties and small worked cases of the spatial engine."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.mvt_encoder import tile
from tilewright.functions import formatting, geo
from tilewright.operators import graph, routes, search, store
from tilewright.sources import mvt
from tilewright.streaming import navigation


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_tile_round_trip(spark):
    features = [(5, 2, {"class": "service", "n": -3, "x": 1.5, "ok": True}, [[(0, 0), (10, -4)], [(7, 7), (8, 8), (9, 1)]]), (6, 3, {"class": "a"}, [[(0, 0), (4, 0), (4, 4)]]), (7, 1, {}, [[(3, 3)]])]
    data = tile([("roads", 4096, features), ("poi", 512, [(1, 1, {"name": "é"}, [[(1, 2)]])])])
    got = mvt.read(data)
    assert [(x["name"], x["extent"]) for x in got] == [("roads", 4096), ("poi", 512)]
    first, second, third = got[0]["features"]
    assert first["paths"] == features[0][3] and first["id"] == 5
    assert {k: next(v for v in x.values() if v is not None) for k, x in first["props"].items()} == {"class": "service", "n": -3.0, "x": 1.5, "ok": True}
    assert second["paths"][0][-1] == second["paths"][0][0] and third["type"] == 1
    df = rows(spark, [("a", data), ("b", b""), ("c", b"\x1a\xff"), ("d", None)], "k string, data binary")
    out = mvt.features(df, layers=["poi"]).collect()
    assert [(r.tile, r.layer, r.props["name"].s) for r in out] == [("a", "poi", "é")]


def test_eviction(spark):
    smart = [(i, f"k{i}", 100_000, "smart", i, None) for i in range(10)]
    schema = "tile_id long, k string, size long, tier string, day int, pinned_by string"
    metas = rows(spark, smart + [(99, "p", 900_000, "permanent", 0, None)], schema).withColumn("last_access", F.timestamp_seconds(F.col("day") * 86400))
    gone = {r.tile_id for r in store.evict(metas, 500_000).collect()}
    assert gone == set(range(6))  # never the permanent one
    assert store.pressure(metas, 500_000).collect()[0].pressure == "critical"
    assert {r.tile_id for r in store.evict(metas, 500_000, F.col("tile_id") == 0).collect()} == set(range(1, 7))
    assert store.evict(metas, 5_000_000).count() == 0


def test_corridor_shrinks_to_cap(spark):
    segs = rows(spark, routes.segments([(-77.0, 40.0), (-76.0, 40.28)]), "i int, ax double, ay double, bx double, by double, before double, n double")
    wide, r1 = routes.corridor_within(segs, 13, 2000.0, 1400)
    few, r2 = routes.corridor_within(segs, 13, 20000.0, 100)
    assert r1 == 2000.0 and wide.count() > 20 and r2 < 20000 and (few.count() <= 100 or r2 == 200)


def brute(edges, origin):
    dist = {origin: 0.0}
    for _ in range(len(edges)):
        more = False
        for a, b, c in edges:
            if a in dist and dist[a] + c < dist.get(b, math.inf) - 1e-12:
                dist[b], more = dist[a] + c, True
        if not more:
            return dist
    return dist


def test_paths_and_distances(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(30), rng.randrange(30), rng.random() * 9 + 0.1) for _ in range(90)]
    e = rows(spark, edges, "src long, dst long, cost double")
    want = brute(edges, edges[0][0])
    got = {r.node: r.cost for r in graph.distances(e, edges[0][0]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    req = rows(spark, [(i, edges[0][0], i) for i in range(31)], "id long, origin long, target long")
    nodes = {x for a, b, _ in edges for x in (a, b)}
    for r in graph.shortest_paths(req, e).collect():
        if r.id in want:
            assert abs(r.cost - want[r.id]) < 1e-9 and r.path[0] == edges[0][0] and r.path[-1] == r.id
        else:
            assert r.reason == ("no-path" if r.id in nodes else "no-destination")


def test_components(spark):
    e = rows(spark, [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
    n = rows(spark, [(i,) for i in [*range(41), 100, 101, 500]], "node long")
    got = {r.node: (r.component, r.size) for r in graph.components(e, n).collect()}
    assert got[40] == (0, 41) and got[101] == (100, 2) and got[500] == (500, 1)


def test_steps():
    def leg(lng, lat, lng2, lat2, name, cls="residential"):
        return {"lng": lng, "lat": lat, "lng2": lng2, "lat2": lat2, "name": name, "cls": cls, "junction": True, "length_m": 500.0, "seconds": 60.0}

    out = graph.steps(pd.DataFrame([leg(0, 0, 0, 0.005, "A"), leg(0, 0.005, 0, 0.01, "A"), leg(0, 0.01, 0.005, 0.01, "B"), leg(0.005, 0.01, 0.005, 0.005, None)]))
    assert [(s["type"], s["modifier"], s["name"], s["distance_m"]) for s in out] == [("depart", None, "A", 1000.0), ("turn", "right", "B", 500.0), ("turn", "right", "the street", 500.0), ("arrive", None, "", 0.0)]


def test_simplify_keeps_what_matters():
    line = [(0.0, 0.0), (0.001, 0.0000001), (0.002, 0.0), (0.003, 0.01), (0.004, 0.0)]
    assert graph.simplify(line, 5.0) == [line[0], line[2], line[3], line[4]]
    assert graph.simplify(line[:1], 5.0) == line[:1]


def test_search_and_merge(spark):
    docs = rows(spark, [("1", "Main St", "street", 25, 0.0, 0.0), ("2", "Maine", "city", 120, 1.0, 1.0), ("3", "Old Main", "street", 25, 0.0, 0.0)], "id string, name string, kind string, boost int, lng double, lat double")
    assert [r.id for r in search.search(docs, " MAIN ").collect()] == ["2", "1", "3"]
    assert search.search(docs, "  ").count() == 0
    chain = [(str(i), "A", 0.015 * i, 0.0, i) for i in range(4)]
    got = search.merge(rows(spark, chain, "id string, name string, lng double, lat double, rank long"), rows(spark, chain[:1], "id string, name string, lng double, lat double, rank long"))
    assert [(r.id, r.source) for r in got.collect()] == [("0", 0), ("2", 0)]  # 1 is near 0; 2 is near 1 only, which went
    assert search.degraded(0, 3, True) and not search.degraded(0, 0, True)


def test_formatting_breaks(spark):
    df = rows(spark, [(0.0,), (944.0,), (950.0,), (9949.0,), (10000.0,)], "m double")
    assert [r.t for r in df.select(formatting.distance(F.col("m")).alias("t")).collect()] == ["0 m", "940 m", "1.0 km", "9.9 km", "10 km"]
    df = rows(spark, [(1023,), (1024,), (1 << 20,), (3 << 30,)], "n long")
    assert [r.t for r in df.select(formatting.size(F.col("n")).alias("t")).collect()] == ["1023 B", "1 KB", "1.0 MB", "3.00 GB"]


def fixes(n=40):
    out = []
    for i in range(n):
        off = 0.01 if 10 <= i < 16 else 0.0
        out.append((i % 2, i, i * 4000, -77.0 + i / (n - 1), 40.0 + 0.28 * i / (n - 1) + off, 5.0))
    return out


def test_stream_equals_batch(spark, tmp_path):
    schema = "trip_id long, event_id long, ts_ms long, lng double, lat double, accuracy double"
    route = [(-77.0, 40.0), (-76.0, 40.28)]
    want = sorted(map(tuple, navigation.batch(rows(spark, fixes(), schema), route).collect()))
    for i, part in enumerate((fixes()[:18], fixes()[18:])):
        rows(spark, part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = navigation.stream(source, route).writeStream.format("memory").queryName("nav").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("nav").collect()))
    assert len(got) == len(want) and got == want
    assert any(r[-1] for r in want) and sum(r[-2] for r in want) == 1  # a reroute; one trip gets to the end


@pytest.mark.parametrize("start,end", [((0.0, 0.0), (0.0, 0.0)), ((179.0, 10.0), (-179.0, 10.0))])
def test_distance_is_symmetric(spark, start, end):
    r = spark.range(1).select(geo.haversine_m(*map(F.lit, (*start, *end))).alias("a"), geo.haversine_m(*map(F.lit, (*end, *start))).alias("b")).collect()[0]
    assert abs(r.a - r.b) < 1e-6 and r.a < 230_000
