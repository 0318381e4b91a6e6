"""Goal-directed searches by joins against a heap, with modes, reasons and the paths themselves; graphs of merged vertices."""

import heapq
import random

from pyspark.sql import functions as F

from tilewright.functions import lookups
from tilewright.operators import frontier, routes, tilegraph
from tilewright.plans.graph import checkpointed


def dijkstra(edges, origin):
    best, heap = {origin: 0.0}, [(0.0, origin)]
    while heap:
        c, n = heapq.heappop(heap)
        if c > best[n]:
            continue
        for m, s in edges.get(n, {}).items():
            if c + s < best.get(m, float("inf")):
                best[m] = c + s
                heapq.heappush(heap, (c + s, m))
    return best


def test_against_a_heap(spark):
    rng = random.Random(7)
    place = {i: (-77 + rng.random() * 0.05, 40 + rng.random() * 0.05) for i in range(90)}
    rows = []
    for a in place:
        for b in sorted(place, key=lambda q: (place[a][0] - place[q][0]) ** 2 + (place[a][1] - place[q][1]) ** 2)[1:4]:
            m = routes.haversine(place[a], place[b]) * rng.uniform(1.0, 1.6)
            cls = rng.choice(["motorway", "residential", "footway", "service", "path", "odd"])
            rows += [(a, b, m, cls)] + ([(b, a, m, cls)] if rng.random() < 0.7 else [])
    rows += [(500, 501, 50.0, "residential"), (0, 0, 5.0, "residential")]
    place |= {500: (-76.0, 41.0), 501: (-76.0, 41.001)}
    asked = [(i, rng.choice([0, 1, 2, 3, 500]), rng.choice([*range(90), 501, 900]), rng.choice(["car", "bicycle", "foot"])) for i in range(150)]
    asked += [(150, 800, 1, "car"), (151, None, 1, "car"), (152, 1, None, "car"), (153, 1, 2, None), (154, 1, 2, "boat"), (155, 4, 4, "foot"), (155, 4, 4, "foot")]
    checkpointed(spark)
    out = frontier.shortest_paths(
        spark.createDataFrame(asked, "id long, origin long, target long, mode string"),
        spark.createDataFrame(rows, "src long, dst long, length_m double, cls string"),
        spark.createDataFrame([(i, *p) for i, p in place.items()], "node long, lng double, lat double"),
    ).collect()
    assert sorted(r.id for r in out) == sorted(a[0] for a in asked)
    met, by = {n for r in rows for n in r[:2]}, {a[0]: a for a in asked}
    costs = {}
    for mode, speed in lookups.MODE_SPEED.items():
        for a, b, m, cls in rows:
            if mode in lookups.CLASS_MODES.get(cls, []):
                s = m / 1000 / min(lookups.CLASS_SPEED[cls], speed) * 3600
                own = costs.setdefault(mode, {}).setdefault(a, {})
                own[b] = min(s, own.get(b, s))
    seen = set()
    for r in out:
        _, origin, target, mode = by[r.id]
        if origin not in met or target not in met:
            assert r.reason == ("no-origin" if origin not in met else "no-destination") and r.path == []
            continue
        want = dijkstra(costs.get(mode, {}), origin).get(target)
        assert (r.cost is None) == (want is None) == (r.reason == "no-path")
        if want is not None:
            assert abs(r.cost - want) < 1e-6 and r.path[0] == origin and r.path[-1] == target
            assert abs(sum(costs[mode][a][b] for a, b in zip(r.path, r.path[1:], strict=False)) - want) < 1e-6
            seen.add(len(r.path))
    assert len(seen) > 5 and {r.reason for r in out} == {None, "no-origin", "no-destination", "no-path"}


def test_merged_segments(spark):
    """Vertices one column apart far north become one node; near the equator they stay two."""
    row = lambda seg, ax, ay, bx, by: (seg, "t", ax, ay, bx, by, "residential", 0, False, 0.0, None, 1.0, 1.0)
    north, south = 1_800_000, 1_300_000  # 54.9 and 39.7 degrees
    rows = [row("a", 0, north, 100, north), row("b", 101, north, 101, north + 50), row("c", 100, north, 101, north), row("d", 0, south, 100, south), row("e", 101, south, 101, south + 50), row("f", 100, south, 101, south)]
    df = spark.createDataFrame(rows, "seg string, tile string, ax long, ay long, bx long, by long, cls string, oneway int, ramp boolean, level double, name string, length_m double, seconds double")
    got = {r.seg: r for r in tilegraph.merged(df).collect()}
    assert set(got) == {"a", "b", "d", "e", "f"}
    assert (got["b"].ax, got["b"].bx) == (100, 101) and (got["e"].ax, got["f"].bx) == (101, 101)
    assert abs(got["a"].length_m - routes.haversine((0, north / 32768), (100 / 32768, north / 32768))) < 1e-6 and got["d"].length_m == 1.0
    assert tilegraph.merged(df.where(F.lit(False))).count() == 0


def test_probes_against_a_loop(spark):
    rng, rows, t = random.Random(1), [], 0
    for i in range(600):
        t += rng.choice((0, 1000, 9000, 14_000))
        rows.append((i // 300, t, i, rng.random() < 0.15))
    checkpointed(spark)
    got = routes.failure_probes(spark.createDataFrame(rows, "k long, ts_ms long, i long, ok boolean"), "k", tie="i").collect()
    want = []
    for k in (0, 1):
        recent = []
        for _, ts, _, ok in (r for r in rows if r[0] == k):
            recent = [] if ok else [x for x in recent if ts - x < 30_000] + [ts]
            if len(recent) >= 3:
                want.append((k, ts))
                recent = []
    assert len(want) > 20 and sorted((r.k, r.ts_ms) for r in got) == sorted(want)
