"""What must not grow with the tables: batches of tiles, paths that share their beginnings, searches over long graphs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_frontier import dijkstra
from tilewright.operators import graph, greedy, pathtree, routes, store, tilegraph
from tilewright.plans import roads
from tilewright.plans.graph import QUERIES, checkpointed
from tilewright.sources import mvt


class Caught:
    """Stands for a DataFrame, to get at the function that a task runs."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_tiles_are_read_in_bounded_batches(spark):
    rows = [{"id": i, "type": 2, "props": [("class", {"s": "service"})] if i % 2 else [], "paths": [[{"x": i, "y": 1}, {"x": 2, "y": 3}]]} for i in range(1500)]
    tile = mvt.write_layer("road", 4096, rows)
    run = mvt.features(Caught())
    out = list(run(iter([pa.record_batch({"k": ["a", "b", "bad", "none"], "data": pa.array([tile, tile, tile[:50], None], pa.binary())}) for _ in range(2)])))
    assert [b.num_rows for b in out] == [mvt.BATCH] * 6
    got = pa.Table.from_batches(out).to_pylist()
    assert [(r["tile"], r["id"], r["pos"]) for r in got] == [(k, i, i) for k in "abab" for i in range(1500)]
    assert dict(got[1]["props"])["class"]["s"] == "service" and got[2]["props"] == [] and got[7]["paths"] == [[{"x": 7, "y": 1}, {"x": 2, "y": 3}]]


def _plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["jon6_dead_end_join", "jon4_name_join", "agg13_name_count"])
def test_tiles_are_read_once(spark, name):
    """What reads tiles' features several times takes them from the checkpoint folder, not from the tiles each time."""
    rows = roads.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in _plan(rows)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()  # of all segments, by way of the driver


def test_vertices_are_worked_out_once(spark):
    """A path's vertices are worked out in one place of the plan, and a tile's key is not taken apart for each of them."""
    spark.conf.set("spark.sql.maxToStringFields", "1000")
    try:
        plan = _plan(tilegraph.segments(mvt.features(spark.createDataFrame([("planet/13/0/0", b"")], "k string, data binary"))))
    finally:
        spark.conf.unset("spark.sql.maxToStringFields")
    made = [x for x in plan.splitlines() if "transform(" in x]
    assert len(made) == 1 and made[0].count("transform(") == 1 and "split(" not in made[0]


def test_distances_through_blocks(spark):
    """A long grid in blocks of 25 nodes against a heap, and a graph whose ids say nothing about places."""
    rng = random.Random(3)
    checkpointed(spark)
    for name, most in ((lambda n: n, 0), (lambda n: n * 7919 % 1000, 1)):
        rows = [(name(a), name(b), rng.uniform(1, 9)) for n in range(600 if not most else 120) for a, b in ((n, n + 1), (n, n + 5), (n + 5, n)) if rng.random() < 0.9]
        rows += [(5000, 5001, 1.0), (name(0), name(0), 1.0), (name(1), name(1), 0.0)]
        costs = {}
        for a, b, c in rows:
            own = costs.setdefault(a, {})
            own[b] = min(c, own.get(b, c))
        want = dijkstra(costs, name(0))
        got = {r.node: r.cost for r in graph.distances(spark.createDataFrame(rows, "src long, dst long, cost double"), name(0), block=25 if not most else 60).collect()}
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)
        assert len(want) > 100


def test_distance_along_shared_beginnings(spark):
    """As path_distance() has it for each path, with a leg that isn't there and stretches' ends."""
    n = graph.STRETCH + 20
    edges = spark.range(n).where("id <> 4110").selectExpr("id as src", "id + 1 as dst", "cast(id % 7 + 1 as double) as length_m")
    lines = spark.range(n).selectExpr("cast(3 as bigint) as line", "id as i", "id as src", "id + 1 as dst")
    asked = [0, 1, 2, graph.STRETCH - 1, graph.STRETCH, graph.STRETCH + 1, 4110, 4111]
    got = {r.id: r.m for r in graph.distance_along(lines, spark.createDataFrame([(a, 3, a) for a in asked], "id long, line long, n long"), edges).collect()}
    assert got == {a: float(sum(i % 7 + 1 for i in range(a))) if a < 4111 else None for a in asked if a}


def test_requests_cut_a_large_graph(spark):
    """More edges than may be broadcast, but few where requests lead from one node to another."""
    checkpointed(spark)
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(50)] + [(-100, -101, 1.0), (-101, -102, 2.0)], "src long, dst long, cost double")
    asked = [(1, -5, 3), (2, 3, -5), (3, 0, -101), (4, -101, -100), (5, 3, 3), (6, -100, -102)]
    rows = graph.shortest_paths(spark.createDataFrame(asked, "id long, origin long, target long"), edges, most=10).collect()
    assert {r.id: (r.cost, r.path, r.reason) for r in rows} == {1: (None, [], "no-origin"), 2: (None, [], "no-destination"), 3: (None, [], "no-path"), 4: (None, [], "no-path"), 5: (0.0, [3], None), 6: (3.0, [-100, -101, -102], None)}


def test_equally_large_tiles_of_an_area(spark):
    """Which of equally large rows of a key counts doesn't hang on the order in which they come."""
    area = spark.createDataFrame([(1, -77.0, 40.0, -76.99, 40.01, 4)], "id int, west double, south double, east double, north double, max_zoom int")
    k = store.area_download(area, spark.createDataFrame([], "k string, size long, tier string")).first()
    rows = [(i, f"planet/{k.z}/{k.x}/{k.y}", 7, "permanent" if i == 2 else "smart") for i in range(2, 9)]
    for own in (rows, rows[::-1]):
        assert [r.action for r in store.area_download(area, spark.createDataFrame(own, "tile_id long, k string, size long, tier string")).collect()] == ["keep"]


def test_corridors_are_made_from_legs(spark, monkeypatch):
    """No tile is shuffled, sorted or joined, and a key's tiles are the same however few of them a task looks at together."""
    rng = random.Random(8)
    lines = {k: [(-77 + rng.random() * 0.4, 40 + rng.random() * 0.2) for _ in range(rng.randrange(2, 9))] for k in range(6)}
    rows = [(k, *a, *b) for k, line in lines.items() for a, b in zip(line, line[1:], strict=False)] + [(9, None, 40.0, -77.0, 40.0)]
    segs = spark.createDataFrame(rows, "k long, ax double, ay double, bx double, by double")
    plan = routes.corridors(segs, "k", 13, 4000.0, 60)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Join", "Aggregate", "Generate"))
    want = {tuple(r) for r in routes.corridors(segs, "k", 13, 4000.0, 60).collect()}
    for k, line in lines.items():
        one = spark.createDataFrame(routes.segments(line), "i int, ax double, ay double, bx double, by double, before double, n double")
        found, radius = routes.corridor_within(one, 13, 4000.0, 60)
        assert {r[1:] for r in want if r[0] == k} == {(13, r.x, r.y, radius) for r in found.collect()}
    monkeypatch.setattr(type(segs), "mapInArrow", lambda self, run, schema: (self, run))
    legs, run = routes.corridors(segs, "k", 13, 4000.0, 60)
    batches = [b for got in legs.toArrow().to_batches() for b in (got.slice(0, 3), got.slice(3))]
    for most in (1, 40, 1 << 19):
        monkeypatch.setattr(routes, "TILES_AT_ONCE", most)
        out = pa.Table.from_batches(run(iter(batches))).to_pylist()
        assert {tuple(r.values()) for r in out} == want and len(out) == len(want)


def test_steps_of_paths_that_begin_alike(spark, monkeypatch):
    """As steps_along() has them path by path, over chunks of a line's manoeuvres; lines, not paths, are what is numbered."""
    checkpointed(spark)
    rng = random.Random(5)
    legs = []
    for line in range(4):
        for i in range(30):
            if i != 7 * line:
                at = [round(rng.uniform(0, 0.02), 4) for _ in range(4)] if line else [i * 0.001, 0.0, i * 0.001 + 0.001, 0.0]
                legs.append((line, i, *at, rng.choice(["primary", "service", "trunk_link"]), rng.choice(["A", "B", None]), rng.random() < 0.8, rng.choice([10.0, 30.0, 150.0]), 2.0, rng.random() < 0.2, rng.random() < 0.2))
    names = "lng double, lat double, lng2 double, lat2 double, cls string, name string, junction boolean, length_m double, seconds double, ramp boolean, roundabout boolean"
    ends = [(100 * line + n, line, n) for line in range(4) for n in range(31)]
    paths = [(id_, *leg[1:]) for id_, line, n in ends for leg in legs if leg[0] == line and leg[1] < n]
    want = sorted(map(tuple, graph.steps_along(spark.createDataFrame(paths, f"id long, i int, {names}")).collect()), key=repr)
    lines, asked = spark.createDataFrame(legs, f"line long, i int, {names}"), spark.createDataFrame(ends, "id long, line long, n long")
    for most in (3, 256):
        monkeypatch.setattr(graph, "STEP_CHUNK", most)
        assert sorted(map(tuple, graph.steps_to_ends(lines, asked).collect()), key=repr) == want
    assert len({r[0] for r in want}) == 119 and any(r[2] == "continue" for r in want)  # five ends come before any leg


def test_two_bounds_are_sought_in_one_tree(spark):
    """The first place where either value is as large as asked for, over three levels, also where values are null."""
    rng = random.Random(6)
    n = greedy.FAN**2 + 300
    values = [(rng.random() if rng.random() < 0.9 else None, rng.random()) for _ in range(n)]
    rows = spark.createDataFrame([(1, i, *v) for i, v in enumerate(values)], "k long, n long, a double, b double")
    tree = greedy.Tree(rows, "k", [F.col("a"), F.col("b")], 3)
    asked = [(1, i, rng.randrange(n), 1 - rng.random() ** 6, 1 - rng.random() ** 6) for i in range(60)] + [(1, 99, None, 0.0, 0.0), (1, 100, 5, 2.0, 2.0)]
    got = tree.first_at_least(spark.createDataFrame(asked, "k long, n long, start long, x double, y double"), "start", ["x", "y"], "out").collect()
    want = {i: None if start is None else next((j for j in range(start, n) if (values[j][0] or 0) >= x or values[j][1] >= y), None) for _, i, start, x, y in asked}
    assert {r.n: r.out for r in got} == want


def test_steps_of_a_line_are_worked_out_once(spark, monkeypatch):
    """Paths copy them rounded and numbered, in as many tasks as the steps take."""
    checkpointed(spark)
    monkeypatch.setattr(graph, "STEPS_A_TASK", 1)
    names = "i int, lng double, lat double, lng2 double, lat2 double, cls string, name string, junction boolean, length_m double, seconds double, ramp boolean, roundabout boolean"
    legs = [(i, i * 0.001, i % 3 * 0.001, i * 0.001 + 0.001, (i + 1) % 3 * 0.001, "primary", "A", True, 50.0 + i / 7, 1 / (i + 3), False, False) for i in range(9)]
    paths = spark.createDataFrame([(n, *leg) for n in range(1, 10) for leg in legs[:n]], f"id long, {names}")
    want = list(map(tuple, graph.steps_along(paths).withColumns({c: F.round(c, 2) for c in ("distance_m", "duration_s")}).collect()))
    out = graph.steps_to_ends(spark.createDataFrame([(1, *leg) for leg in legs], f"line long, {names}"), spark.createDataFrame([(n, 1, n) for n in range(1, 10)], "id long, line long, n long"), places=2)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "Generate inline" in plan and "round(" not in plan
    assert out.rdd.getNumPartitions() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_steps_of_all_paths_of_a_tree(spark, monkeypatch):
    """As steps_along() has them path by path, with manoeuvres nearer than the gap, first ones too short to go on from, and
    lists shorter and longer than the paths."""
    checkpointed(spark)
    rng = random.Random(11)
    legs = {}
    for node in range(1, 90):
        up = rng.randrange(max(0, node - 3), node) if node < 85 else 0
        at = [round(rng.uniform(0, 0.02), 4) for _ in range(4)] if node % 5 else [up * 0.001, 0.0, up * 0.001 + 0.001, 0.0]
        legs[node] = (up, *at, rng.choice(["primary", "service", "trunk_link"]), rng.choice(["A", "B", None]), rng.random() < 0.8, rng.choice([4.0, 10.0, 30.0, 150.0]), 2.0, rng.random() < 0.2, rng.random() < 0.2)
    names = "lng double, lat double, lng2 double, lat2 double, cls string, name string, junction boolean, length_m double, seconds double, ramp boolean, roundabout boolean"
    paths = []
    for node in legs:
        way = [node]
        while legs[way[-1]][0]:
            way.append(legs[way[-1]][0])
        paths += [(node, i, *legs[n][1:]) for i, n in enumerate(reversed(way))]
    want = sorted(map(tuple, graph.steps_along(spark.createDataFrame(paths, f"id long, i int, {names}")).collect()), key=repr)
    tree = spark.createDataFrame([(node, *leg) for node, leg in legs.items()], f"node long, up long, {names}")
    for chunk in (3, 64):
        monkeypatch.setattr(pathtree, "CHUNK", chunk)
        assert sorted(map(tuple, pathtree.steps_to_nodes(tree).collect()), key=repr) == want
    assert {r[0] for r in want} == legs.keys() and any(r[2] == "continue" for r in want) and max(r[1] for r in want) > 9


def test_long_paths_of_a_tree_copy_few_lists(spark, monkeypatch):
    """A path of 50 manoeuvres takes lists of 9, of 3 and what is left, not seventeen of 3."""
    checkpointed(spark)
    monkeypatch.setattr(pathtree, "CHUNK", 3)
    seen, kept = [], pathtree.kept
    monkeypatch.setattr(pathtree, "kept", lambda rows: seen.append(kept(rows)) or seen[-1])
    names = "lng double, lat double, lng2 double, lat2 double, cls string, name string, junction boolean, length_m double, seconds double, ramp boolean, roundabout boolean"
    legs = [(i + 1, i, i * 0.001, i % 2 * 0.001, i * 0.001 + 0.001, (i + 1) % 2 * 0.001, "primary", "A", True, 50.0, 1.0, False, False) for i in range(51)]
    out = pathtree.steps_to_nodes(spark.createDataFrame(legs, f"node long, up long, {names}")).collect()
    assert sorted((r.id, r.step) for r in out) == [(n, k) for n in range(1, 52) for k in range(n + 1)]
    parts = max(r.n or 0 for rows in seen if {"parts", "skips"} <= set(rows.columns) for r in rows.select(F.size("parts").alias("n")).collect())
    assert 50 // 9 < parts <= 50 // 9 + 3


def test_tree_of_cheapest_paths(spark):
    """Of equal ways the one over the smallest node, and none back to the origin."""
    edges = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 0, 1.0), (3, 4, 0.5), (9, 4, 0.1), (4, 3, 0.5)], "src long, dst long, cost double")
    costs = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, 2.5)], "node long, cost double")
    assert sorted(map(tuple, pathtree.of_costs(edges, costs).collect())) == [(1, 0), (2, 0), (3, 1), (4, 3)]


def test_steps_are_not_written_path_by_path(spark, monkeypatch):
    """grf14_steps neither takes the graph to the driver nor writes paths out before their steps."""
    monkeypatch.setattr(graph, "shortest_paths", None)
    monkeypatch.setattr(graph, "steps_along", None)
    assert QUERIES["grf14_steps"](spark, "/root/testdata/sf0.001").count() > 1000
