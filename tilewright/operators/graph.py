"""Road graphs: edges from ways, adjacency, components, nearest nodes, shortest paths, steps."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions import geo, lookups
from tilewright.operators import greedy

QUANT = 32768
#: Graphs of up to so many edges are broadcast to the tasks that search paths; larger ones take the frontier joins.
BROADCAST_EDGES = 4_000_000


def quantize(v: Column) -> Column:
    """To the grid of 1 / QUANT degrees, halves up."""
    return F.floor(v * QUANT + 0.5) / QUANT


def vertex_id(lng: Column, lat: Column) -> Column:
    x, y = F.floor(lng * QUANT + 0.5).cast("long"), F.floor(lat * QUANT + 0.5).cast("long")
    return (x + (1 << 23)) * (1 << 23) + (y + (1 << 22))


def road_features(features: DataFrame) -> DataFrame:
    """Lines of two points or more with a class (class, else kind); minor counts as residential."""
    cls = F.coalesce("class", "kind")
    return features.where((F.col("type") == 2) & (F.col("n_points") >= 2) & (F.coalesce(cls, F.lit("")) != "")).withColumn("cls", F.when(cls == "minor", "residential").otherwise(cls))


def directed(ways: DataFrame) -> DataFrame:
    """One row for each way that may be driven in a direction: both for oneway 0, forward for 1, backward for -1."""
    there, back = F.struct(F.col("f").alias("src"), F.col("t").alias("dst")), F.struct(F.col("t").alias("src"), F.col("f").alias("dst"))
    ends = F.when(F.col("oneway") == 1, F.array(there)).when(F.col("oneway") == -1, F.array(back)).otherwise(F.array(there, back))
    return ways.withColumn("_e", F.explode(ends)).select("_e.src", "_e.dst", "cls", "nm")


def path_distance(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, m): the summed length_m of the edges (src, dst, length_m) along paths (id, nodes), of parallel edges the
    shortest; a path of one node has no row, one over an edge that isn't there null."""
    pair = lambda i: F.struct(F.get("nodes", i - 1).alias("src"), F.get("nodes", i).alias("dst"))
    legs = paths.where(F.size("nodes") > 1).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), pair)).alias("e")).select("id", "e.*")
    known = edges.groupBy("src", "dst").agg(F.min("length_m").alias("length_m"))
    summed = legs.join(known, ["src", "dst"], "left").groupBy("id").agg(F.sum("length_m").alias("m"), F.count_if(F.col("length_m").isNull()).alias("gaps"))
    return summed.select("id", F.when(F.col("gaps") == 0, F.col("m")).alias("m"))


#: Legs of a line that one window sums.
STRETCH = 4096


def distance_along(lines: DataFrame, ends: DataFrame, edges: DataFrame) -> DataFrame:
    """path_distance() of paths that share their beginnings: (id, m) for ends (id, line, n), the first n legs of lines
    (line, i, src, dst), i from 0 without gaps. A leg is summed once, however many paths take it, in windows of STRETCH legs."""
    known = edges.groupBy("src", "dst").agg(F.min("length_m").alias("length_m"))
    legs = lines.join(known, ["src", "dst"], "left").select("line", "i", F.floor(F.col("i") / STRETCH).alias("_s"), F.coalesce("length_m", F.lit(0.0)).alias("_m"), F.col("length_m").isNull().cast("int").alias("_gap"))
    w, over = Window.partitionBy("line").orderBy("_s"), Window.partitionBy("line", "_s").orderBy("i")
    sums = legs.groupBy("line", "_s").agg(F.sum("_m").alias("_m0"), F.sum("_gap").alias("_gap0"))
    sums = sums.select("line", "_s", *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in ("_m0", "_gap0")])
    upto = legs.select("line", "i", "_s", F.sum("_m").over(over).alias("_m"), F.sum("_gap").over(over).alias("_gap")).join(sums, ["line", "_s"])
    return ends.select("id", "line", (F.col("n") - 1).alias("i")).join(upto, ["line", "i"]).select("id", F.when(F.col("_gap") + F.col("_gap0") == 0, F.col("_m") + F.col("_m0")).alias("m"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges in and out of each node; a junction has more than two."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).withColumn("junction", F.col("degree") > 2)


def node_rank(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.max(lookups.class_rank(F.col("cls"))).alias("rank"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component, size): least node reachable over edges of either direction. Large and small stars in turn, each
    round written to the checkpoint folder; a few rounds do, however long the paths are."""
    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct().checkpoint()
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
        if got == mark:
            break
        mark = got
    labelled = nodes.join(now, nodes["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
    return labelled.join(labelled.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


def nearest_node(points: DataFrame, nodes: DataFrame, max_m: float = 5000.0, near_m: float = 150.0, cell: float = 0.01) -> DataFrame:
    """(id, node, m) for points (id, lng, lat) and nodes (node, lng, lat, rank): within near_m the highest rank, then the
    nearest; beyond it the nearest. Points meet nodes in cells, so that the join is by equality: first those of the cells
    next to theirs, and only where that can't settle it those of all cells that max_m can reach.

    Of the nodes in one place only the first by rank and the first by name can win, and equal places have equal nodes, so
    places meet once however many points and nodes lie there."""
    places = points.select("lng", "lat").distinct()
    n = nodes.groupBy("lng", "lat").agg(F.min(F.struct((-F.col("rank")).alias("r"), "node", "rank")).alias("a"), F.min(F.struct("node", "rank")).alias("b"))
    n = n.select("lng", "lat", F.inline(F.array_distinct(F.array(F.struct("a.node", "a.rank"), F.struct("b.node", "b.rank")))))
    n = n.select("node", F.col("lng").alias("nx"), F.col("lat").alias("ny"), "rank", F.floor(F.col("lng") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    order = F.struct((F.col("m") > near_m).alias("far"), F.when(F.col("m") <= near_m, -F.col("rank")).otherwise(0).alias("r"), "m", "node")

    def best(own: DataFrame, k: int) -> DataFrame:
        around = F.sequence(F.lit(-k), F.lit(k))
        p = own.withColumn("cx", F.explode(F.transform(around, lambda i: F.floor(F.col("lng") / cell) + i))).withColumn("cy", F.explode(F.transform(around, lambda i: F.floor(F.col("lat") / cell) + i)))
        both = p.join(n, ["cx", "cy"]).withColumn("m", geo.haversine_m(F.col("lng"), F.col("lat"), F.col("nx"), F.col("ny"))).where(F.col("m") <= max_m)
        return both.groupBy("lng", "lat").agg(F.min(order).alias("b"))

    # What lies beyond the cells next to a place is a cell's width away at least.
    width = cell * geo.DEGREE_M * 0.99 * F.cos(F.radians(F.abs("lat") + cell))
    settled = best(places, 1).where((F.col("b.m") <= width) & (width >= near_m))
    rest = places.join(settled, ["lng", "lat"], "left_anti")
    found = settled.unionByName(best(rest, math.ceil(max_m / geo.DEGREE_M / cell / 0.5)))
    return points.join(found, ["lng", "lat"]).select("id", "b.node", "b.m")


class Csr:
    """A graph in arrays: edges of node i at first[i]:first[i + 1]."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, cost: np.ndarray) -> None:
        self.nodes = np.unique(np.concatenate([src, dst]))
        s, d = np.searchsorted(self.nodes, src), np.searchsorted(self.nodes, dst)
        order = np.argsort(s, kind="stable")
        self.dst, self.cost = d[order], cost[order]
        self.first = np.searchsorted(s[order], np.arange(len(self.nodes) + 1))

    def index(self, node: int) -> int:
        i = int(np.searchsorted(self.nodes, node))
        return i if i < len(self.nodes) and self.nodes[i] == node else -1

    def paths(self, origin: int, targets: list[int]) -> list[tuple[float | None, list[int], str | None]]:
        """(cost, nodes, why not) for each of the targets, by one search that ends when all are reached."""
        a, at = self.index(origin), [self.index(t) for t in targets]
        if a < 0:
            return [(None, [], "no-origin")] * len(targets)
        best, before, done, left = {a: 0.0}, {}, set(), {b for b in at if b >= 0}
        heap = [(0.0, a)]
        while heap and left:
            _, i = heapq.heappop(heap)
            if i in done:
                continue
            done.add(i)
            left.discard(i)
            for e in range(self.first[i], self.first[i + 1]):
                j, c = int(self.dst[e]), best[i] + float(self.cost[e])
                if c < best.get(j, math.inf):
                    best[j], before[j] = c, i
                    heapq.heappush(heap, (c, j))

        def found(b: int) -> tuple[float | None, list[int], str | None]:
            if b not in done:
                return None, [], "no-destination" if b < 0 else "no-path"
            out = [b]
            while out[-1] != a:
                out.append(before[out[-1]])
            return best[b], [int(self.nodes[x]) for x in reversed(out)], None

        return [found(b) for b in at]


def _with_requests(requests: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of the components in which requests lead from one node to another, and the requests with `_open` for those
    and the answer to the rest: what isn't met, what is there already, and what lies in another component."""
    edges = edges.select("src", "dst", "cost").checkpoint()
    part = components(edges, edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()).select("node", "component").checkpoint()
    at = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    said = requests.select("id", "origin", "target").join(at("origin"), "origin", "left").join(at("target"), "target", "left")
    same, a, b = F.col("origin") == F.col("target"), F.col("_origin"), F.col("_target")
    reason = F.when(a.isNull(), "no-origin").when(b.isNull(), "no-destination").when(a != b, "no-path")
    said = said.select("id", "origin", "target", "_origin", reason.alias("reason"), same.alias("_same"))
    there = F.col("reason").isNull() & F.col("_same")
    said = said.withColumn("cost", F.when(there, 0.0)).withColumn("path", F.when(there, F.array("origin")).otherwise(F.array().cast("array<bigint>"))).withColumn("_open", F.col("reason").isNull() & ~F.col("_same")).checkpoint()
    wanted = said.where("_open").select(F.col("_origin").alias("component")).distinct()
    return edges.join(part.join(wanted, "component", "left_semi").select(F.col("node").alias("src")), "src", "left_semi"), said


def shortest_paths(requests: DataFrame, edges: DataFrame, most: int = BROADCAST_EDGES) -> DataFrame:
    """(id, cost, path, reason) for requests (id, origin, target) over edges (src, dst, cost).

    The requests are many and the graph one: its arrays go to every task, if it has no more than BROADCAST_EDGES edges
    (checked), and tasks search their requests, those of one origin in a batch at once. Larger graphs are cut to the parts,
    joined by edges of either direction, that have requests from one node to another; if these are larger still they must be
    cut to a corridor first and raise ValueError."""
    if edges.limit(most + 1).count() > most:
        edges, said = _with_requests(requests, edges)
        if edges.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} edges: cut the graph to a corridor, or use distances()")
        return said.where("not _open").select("id", "cost", "path", "reason").unionByName(shortest_paths(said.where("_open").select("id", "origin", "target"), edges, most))
    e = edges.select("src", "dst", "cost").toPandas().sort_values(["src", "dst", "cost"])
    graph = requests.sparkSession.sparkContext.broadcast(Csr(e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64), e["cost"].to_numpy(np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [None] * len(batch)
            for origin, at in batch.groupby("origin").indices.items():
                for i, f in zip(at, graph.value.paths(int(origin), batch["target"].iloc[at].tolist()), strict=True):
                    found[i] = f
            yield pd.DataFrame({"id": batch["id"], "cost": [f[0] for f in found], "path": [f[1] for f in found], "reason": [f[2] for f in found]})

    return requests.select("id", "origin", "target").mapInPandas(run, "id long, cost double, path array<long>, reason string")


#: Nodes of a block, blocks that make one of the next level, and how many of a block's gates are searched from at once.
BLOCK, JOINED, AT_ONCE = 1024, 16, 128


def _relaxed(rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame, Callable[[np.ndarray], np.ndarray]]:
    """Of a block's rows (src, dst, cost), those from a node to itself being its gates: all nodes in order, the gates, and
    what brings costs (node, search) down along the edges until none falls."""
    at_gate = (rows["src"] == rows["dst"]).to_numpy()
    gates, own = rows[at_gate], rows[~at_gate].sort_values(["dst", "src"])
    nodes = np.unique(rows[["src", "dst"]].to_numpy(np.int64))
    src, dst, step = np.searchsorted(nodes, own["src"]), np.searchsorted(nodes, own["dst"]), own["cost"].to_numpy(np.float64)[:, None]
    # The first edges into all nodes, the second ones and so on: none of these groups has a node twice.
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
    groups = [(dst[k], src[k], step[k]) for k in (np.flatnonzero(rank == i) for i in range(rank.max(initial=-1) + 1))]

    def settle(costs: np.ndarray) -> np.ndarray:
        falls = True
        while falls:
            falls = False
            for to, of, by in groups:
                new, old = costs[of] + by, costs[to]
                if (new < old).any():
                    falls = True
                    costs[to] = np.minimum(new, old)
        return costs

    return nodes, gates, settle


#: Costs that differ by less than this share are those of one way, added up in another order.
ROUNDING = 1e-13


def _shortcuts(rows: pd.DataFrame) -> pd.DataFrame:
    """(src, dst, cost) from each gate of a block to those that it reaches inside, but for those whose way leads through
    another gate: both parts, each of a lesser cost, are there then."""
    nodes, gates, settle = _relaxed(rows)
    own = np.sort(gates["src"].to_numpy(np.int64))
    at, every = np.searchsorted(nodes, own), np.full((len(own), len(own)), np.inf)
    for k in range(0, len(own), AT_ONCE):
        part = at[k : k + AT_ONCE]
        costs = np.full((len(nodes), len(part)), np.inf)
        costs[part, np.arange(len(part))] = 0.0
        every[k : k + AT_ONCE] = settle(costs)[at].T
    wanted = np.isfinite(every) & ~np.eye(len(own), dtype=bool)
    for c in range(len(own)):
        first, then = every[:, c, None], every[None, c, :]
        wanted &= ~((first < every) & (then < every) & (first + then <= every * (1 + ROUNDING)))
    i, j = np.nonzero(wanted)
    return pd.DataFrame({"src": own[i], "dst": own[j], "cost": every[i, j]})


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    """(node, cost) of a block's nodes that are reached from its gates at their costs."""
    nodes, gates, settle = _relaxed(rows)
    costs = np.full((len(nodes), 1), np.inf)
    costs[np.searchsorted(nodes, gates["src"]), 0] = gates["cost"]
    costs = settle(costs)[:, 0]
    return pd.DataFrame({"node": nodes[np.isfinite(costs)], "cost": costs[np.isfinite(costs)]})


def distances(edges: DataFrame, origin: int, block: int = BLOCK) -> DataFrame:
    """(node, cost) of all nodes reachable from origin, for graphs of any size and length.

    Nodes are dealt into blocks by their ids. The gates of a block, which edges to other blocks meet, and what it costs
    from gate to gate inside it make a smaller graph, whose blocks are JOINED of these; so on until one is left. Costs
    found there go back into the blocks level by level. Where ids say so little about places that the graph doesn't get
    smaller, it is searched by joins."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(origin,)], "node long")
    own = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("cost").alias("cost")).checkpoint()
    nodes = own.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(start).distinct().checkpoint()
    count = nodes.count()
    blocks, levels = math.ceil(count / block), []
    place = nodes.repartitionByRange(blocks, "node").select("node", F.spark_partition_id().alias("block")).checkpoint()
    gate = lambda of, cost: of.select("block", F.col("node").alias("src"), F.col("node").alias("dst"), cost.cast("double").alias("cost"))
    while blocks > 1:
        for end in ("src", "dst"):
            own = own.join(place.select(F.col("node").alias(end), F.col("block").alias(f"_{end}")), end)
        own = own.checkpoint()
        across = own.where("_src <> _dst").select("src", "dst", "cost")
        gates = across.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(start).distinct().join(place, "node").checkpoint()
        fewer = gates.count()
        if fewer * 2 > count:
            return _into_blocks(_by_joins(own.select("src", "dst", "cost"), origin), levels, gate)
        inside = own.where("_src = _dst").select(F.col("_src").alias("block"), "src", "dst", "cost")
        levels.append((inside, place))
        short = inside.unionByName(gate(gates, F.lit(None))).groupBy("block").applyInPandas(_shortcuts, "src long, dst long, cost double")
        own = across.unionByName(short).checkpoint()
        place, count, blocks = gates.select("node", F.floor(F.col("block") / JOINED).cast("int").alias("block")), fewer, math.ceil(blocks / JOINED)
    last = own.select(F.lit(0).alias("block"), "src", "dst", "cost").unionByName(gate(start.withColumn("block", F.lit(0)), F.lit(0.0)))
    return _into_blocks(last.groupBy("block").applyInPandas(_settled, "node long, cost double").checkpoint(), levels, gate)


def _into_blocks(known: DataFrame, levels: list[tuple[DataFrame, DataFrame]], gate) -> DataFrame:
    """Costs of all nodes from those of the gates, level by level."""
    for inside, place in reversed(levels):
        rows = inside.unionByName(gate(known.join(place, "node"), F.col("cost")))
        known = rows.groupBy("block").applyInPandas(_settled, "node long, cost double").checkpoint()
    return known


def _by_joins(own: DataFrame, origin: int, rounds: int = 10_000, hops: int = 4) -> DataFrame:
    """distances() by frontier joins over edges (src, dst, cost).

    A round goes `hops` edges from what the last one improved and is then written to the checkpoint folder."""
    own = own.groupBy("src", "dst").agg(F.min("cost").alias("step")).checkpoint()
    known = own.sparkSession.createDataFrame([(origin, 0.0)], "node long, cost double").checkpoint()
    front = known
    for _ in range(rounds):
        reached = here = front
        for _ in range(hops):
            here = here.join(own, here["node"] == own["src"]).select(F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost")).groupBy("node").agg(F.min("cost").alias("cost"))
            reached = reached.unionByName(here)
        both = reached.withColumn("old", F.lit(None).cast("double")).unionByName(known.withColumn("old", F.col("cost")))
        every = both.groupBy("node").agg(F.min("cost").alias("cost"), F.min("old").alias("old")).checkpoint()
        front = every.where("old is null or cost < old").select("node", "cost")
        if not front.limit(1).count():
            break
        known = every.select("node", "cost")
    return known


def steps(path: pd.DataFrame) -> list[dict]:
    """Turn-by-turn steps of a path: rows (lng, lat of the edge's start and end, cls, name, junction, length_m, seconds,
    and, if they have them, ramp and roundabout). From a link or service road onto a main one that is no ramp is a merge.

    A manoeuvre stands at a junction or a turn of 25 degrees, not within 40 m of the last one, and not where the road goes
    straight on under the same name; distances and durations run to the following step."""
    at, secs, found = 0.0, 0.0, []
    rows = list(path.itertuples(index=False))
    if not rows:
        return []
    say = lambda r: r.name or lookups.CLASS_PHRASE.get(r.cls, "the road")

    def bearing(r) -> float:
        d = math.radians(r.lng2 - r.lng)
        p, q = math.radians(r.lat), math.radians(r.lat2)
        return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360

    found.append({"type": "depart", "modifier": None, "name": say(rows[0]), "cum_m": 0.0, "cum_s": 0.0})
    for prev, row in zip(rows, rows[1:], strict=False):
        at, secs = at + prev.length_m, secs + prev.seconds
        delta = (bearing(row) - bearing(prev) + 540) % 360 - 180
        if not row.junction and abs(delta) < 25 or len(found) > 1 and at - found[-1]["cum_m"] < 40:
            continue
        kind, turn = "turn", _modifier(delta)
        if (prev.cls.endswith("_link") or prev.cls == "service") and row.cls in ("motorway", "trunk", "primary") and not getattr(row, "ramp", False):
            kind, turn = "merge", None if turn in ("straight", "uturn") else turn
        elif getattr(row, "roundabout", False):
            kind = "roundabout"
        elif abs(delta) < 20:
            if prev.name == row.name:
                continue
            kind = "continue"
        found.append({"type": kind, "modifier": turn, "name": say(row), "cum_m": at, "cum_s": secs})
    at, secs = at + rows[-1].length_m, secs + rows[-1].seconds
    found.append({"type": "arrive", "modifier": None, "name": "", "cum_m": at, "cum_s": secs})
    if len(found) > 2 and found[1]["type"] == "continue" and found[2]["cum_m"] - found[1]["cum_m"] < 200:
        del found[1]
    for a, b in zip(found, [*found[1:], found[-1]], strict=True):
        a["distance_m"], a["duration_s"] = b["cum_m"] - a["cum_m"], b["cum_s"] - a["cum_s"]
    return found


#: Metres between manoeuvres, degrees of a turn off a junction, and what is too short to go on before the first manoeuvre.
STEP_GAP_M, STEP_TURN, STEP_FIRST_M = 40.0, 25.0, 200.0


def with_bearing(legs: DataFrame) -> DataFrame:
    """Adds a leg's bearing `_b` and what its road is called, `_said`."""
    name = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.coalesce(*[F.when(F.col("cls") == c, phrase) for c, phrase in lookups.CLASS_PHRASE.items()], F.lit("the road")))
    return legs.select("*", geo.bearing_deg(F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2")).alias("_b"), name.alias("_said"))


def with_kind(rows: DataFrame) -> DataFrame:
    """Adds type, null where no manoeuvre may stand, and modifier to legs with the leg before as `_was` (cls, name, _b)."""
    delta = F.pmod(F.col("_b") - F.col("_was._b") + 540, F.lit(360.0)) - 180
    a, turn = F.abs(delta), lookups.modifier_for(delta)
    merges = (F.col("_was.cls").endswith("_link") | (F.col("_was.cls") == "service")) & F.col("cls").isin("motorway", "trunk", "primary") & ~F.col("ramp")
    kind = F.when(merges, "merge").when(F.col("roundabout"), "roundabout").when((a < 20) & ~F.col("_was.name").eqNullSafe(F.col("name")), "continue").when(a >= 20, "turn")
    rows = rows.withColumn("type", F.when(F.col("_was").isNotNull() & (F.col("junction") | (a >= STEP_TURN)), kind))
    return rows.withColumn("modifier", F.when(F.col("type").isNotNull() & ~((F.col("type") == "merge") & turn.isin("straight", "uturn")), turn))


def _manoeuvres(legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, cum_m, i, type, modifier, name, cum_s) of what many paths begin with and of their manoeuvres, by windows over a
    path; which are too near the last one is found by pointers from each to the next that isn't."""
    w = Window.partitionBy("id").orderBy("i")
    rows = with_bearing(legs).select("*", (F.sum("length_m").over(w) - F.col("length_m")).alias("cum_m"), (F.sum("seconds").over(w) - F.col("seconds")).alias("cum_s"))
    rows = rows.withColumn("_was", F.lag(F.struct("cls", "name", "_b")).over(w)).checkpoint()
    found = with_kind(rows).where("type is not null")
    found = found.select("id", "cum_m", "i", "type", "modifier", F.col("_said").alias("name"), "cum_s")
    found = greedy.counting(found, "id", ["cum_m", "i"], F.floor(F.col("cum_m") / (STEP_GAP_M * greedy.FAN)), STEP_GAP_M)
    first = rows.where(F.col("_was").isNull()).select("id", F.lit(0.0).alias("cum_m"), F.lit(-1).alias("i"), F.lit("depart").alias("type"), F.lit(None).cast("string").alias("modifier"), F.col("_said").alias("name"), F.lit(0.0).alias("cum_s"))
    return first, found


def steps_along(legs: DataFrame) -> DataFrame:
    """(id, step, type, modifier, name, distance_m, duration_s): steps() of many paths, whose legs are rows (id, i, lng, lat,
    lng2, lat2, cls, name, junction, length_m, seconds, ramp, roundabout)."""
    w = Window.partitionBy("id").orderBy("i")
    first, found = _manoeuvres(legs)
    last = legs.groupBy("id").agg(F.sum("length_m").alias("cum_m"), F.lit((1 << 31) - 1).alias("i"), F.lit("arrive").alias("type"), F.lit(None).cast("string").alias("modifier"), F.lit("").alias("name"), F.sum("seconds").alias("cum_s"))
    every = first.unionByName(found).unionByName(last).withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("cum_m").over(w))
    every = every.where((F.col("_n") != 2) | (F.col("type") != "continue") | (F.col("_next") - F.col("cum_m") >= STEP_FIRST_M))
    to = lambda c: F.coalesce(F.lead(c).over(w) - F.col(c), F.lit(0.0))
    return every.select("id", (F.row_number().over(w) - 1).alias("step"), "type", "modifier", "name", to("cum_m").alias("distance_m"), to("cum_s").alias("duration_s"))


#: Manoeuvres of a line that are handed on as one row, and steps that a task copies.
STEP_CHUNK, STEPS_A_TASK = 1024, 1 << 25


def steps_to_ends(lines: DataFrame, ends: DataFrame, places: int | None = None) -> DataFrame:
    """steps_along() of paths that begin alike: the path `id` of ends (id, line, n) is the legs i < n of its line, lines being
    legs with `line` for id; distances and durations are rounded to `places`, if that is given. A line's manoeuvres are found
    once, and their steps worked out once: all paths past the next manoeuvre have the same. What a path adds is where it ends,
    and whether it still goes on long enough after a first manoeuvre to name it. Steps are copied from chunks of a line as
    they are, not sorted, numbered or rounded path by path."""
    w = Window.partitionBy("line").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first, found = _manoeuvres(lines.withColumnRenamed("line", "id"))
    said = first.unionByName(found).withColumnRenamed("id", "line").withColumn("k", F.row_number().over(Window.partitionBy("line").orderBy("i")) - 1)
    along, line = Window.partitionBy("line").orderBy("k"), Window.partitionBy("line")
    following = [F.lead(f"cum_{c}", n).over(along).alias(f"{name}_{c}") for n, name in ((1, "next"), (2, "then")) for c in "ms"]
    said = said.select("*", *following)
    brief = (F.col("k") == 1) & (F.col("type") == "continue") & (F.col("next_m") - F.col("cum_m") < STEP_FIRST_M)
    said = said.withColumn("less", F.coalesce(F.max(brief.cast("int")).over(line), F.lit(0))).checkpoint()
    null = lambda kind: F.lit(None).cast(kind)
    marks = lines.select("line", F.col("i").cast("long").alias("at"), F.lit(1).alias("kind"), null("string").alias("type"), null("int").alias("k"), F.col("length_m").alias("m"), F.col("seconds").alias("s"), null(ends.schema["id"].dataType.simpleString()).alias("id"))
    marks = marks.unionByName(said.where("k > 0").select("line", F.col("i").cast("long").alias("at"), F.lit(2).alias("kind"), "type", "k", F.col("cum_m").alias("m"), F.col("cum_s").alias("s"), null(ends.schema["id"].dataType.simpleString()).alias("id")))
    marks = marks.unionByName(ends.select("line", F.col("n").cast("long").alias("at"), F.lit(0).alias("kind"), null("string").alias("type"), null("int").alias("k"), null("double").alias("m"), null("double").alias("s"), "id"))
    of = lambda when, c: F.max(F.when(when, F.col(c))).over(w)
    leg = F.col("kind") == 1
    asked = marks.select("line", "id", "kind", F.sum(F.when(leg, F.col("m"))).over(w).alias("end_m"), F.sum(F.when(leg, F.col("s"))).over(w).alias("end_s"), F.coalesce(F.max("k").over(w), F.lit(0)).alias("most"), of((F.col("k") == 1) & (F.col("type") == "continue"), "m").alias("_on"), of(F.col("k") == 2, "m").alias("_m2"))
    asked = asked.where("kind = 0 and end_m is not null").withColumn("skips", F.coalesce(F.coalesce("_m2", "end_m") - F.col("_on") < STEP_FIRST_M, F.lit(False))).drop("kind", "_on", "_m2").checkpoint()
    rounded = (lambda c: c) if places is None else (lambda c: F.round(c, places))

    # Steps before a path's last manoeuvre, which all paths of the line that get past the next one share.
    over = F.col("less") * (F.col("k") == 0).cast("int") == 1
    upto = lambda c: rounded(F.when(over, F.col(f"then_{c}")).otherwise(F.col(f"next_{c}")) - F.col(f"cum_{c}"))
    step = F.when(F.col("k") > 0, F.col("k") - F.col("less")).otherwise(0).alias("step")
    own = said.where("not (k = 1 and less = 1)").select("line", F.floor(F.col("k") / STEP_CHUNK).alias("chunk"), F.struct(step, "type", "modifier", "name", upto("m").alias("distance_m"), upto("s").alias("duration_s")).alias("_m"))
    chunks = own.groupBy("line", "chunk").agg(F.array_sort(F.collect_list("_m")).alias("ms"))
    # Few and small rows become many: as many tasks as the steps take, however small what they read, and no fewer than the
    # session has for shuffles. The join says merge, as what is broadcast goes through the driver.
    tasks = max(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((asked.agg(F.sum("most")).first()[0] or 0) / STEPS_A_TASK))
    dealt = asked.where("most > 1").select("id", "line", "most", F.col("skips").cast("int").alias("_less"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("most") - 1) / STEP_CHUNK))).alias("chunk"))
    left = F.col("most") - F.col("chunk") * STEP_CHUNK
    dealt = dealt.select("id", "line", "chunk", F.when(left < STEP_CHUNK, left - F.when(F.col("chunk") == 0, F.col("_less")).otherwise(0)).cast("int").alias("_n")).repartition(tasks, "line", "chunk")
    rows = dealt.join(chunks.repartition(tasks, "line", "chunk").hint("merge"), ["line", "chunk"]).select("id", F.inline(F.when(F.col("_n").isNull(), F.col("ms")).otherwise(F.slice("ms", 1, F.col("_n")))))

    # A path's own: its last step, the one before where that is the first, and its end.
    less = F.col("skips").cast("int")
    mine = asked.withColumn("k", F.explode(F.when(F.col("most") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array("most")))).join(said, ["line", "k"]).where("not (skips and k = 1)")
    last = (F.col("k") == F.col("most")) | F.col("skips") & (F.col("k") == 0)
    to = lambda c: rounded(F.when(last, F.col(f"end_{c}")).otherwise(F.col(f"next_{c}")) - F.col(f"cum_{c}"))
    mine = mine.select("id", F.when(F.col("k") > 0, F.col("k") - less).otherwise(0).alias("step"), "type", "modifier", "name", to("m").alias("distance_m"), to("s").alias("duration_s"))
    arrive = asked.select("id", (F.col("most") + 1 - less).alias("step"), F.lit("arrive").alias("type"), null("string").alias("modifier"), F.lit("").alias("name"), F.lit(0.0).alias("distance_m"), F.lit(0.0).alias("duration_s"))
    return rows.unionByName(mine).unionByName(arrive)


def _modifier(delta: float) -> str:
    side = "right" if delta > 0 else "left"
    a = abs(delta)
    return "uturn" if a >= 160 else f"sharp {side}" if a >= 120 else side if a >= 45 else f"slight {side}" if a >= 20 else "straight"


def simplify(points: list[tuple[float, float]], tolerance_m: float, places: bool = False) -> list:
    """Douglas and Peucker, with a stack: the points kept, or their places."""
    if len(points) < 3:
        return list(range(len(points)) if places else points)
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    k = math.cos(math.radians(points[0][1]))
    xy = [(x * geo.DEGREE_M * k, y * geo.DEGREE_M) for x, y in points]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = xy[a], xy[b]
        n = (bx - ax) ** 2 + (by - ay) ** 2
        far, at = 0.0, None
        for i in range(a + 1, b):
            px, py = xy[i][0] - ax, xy[i][1] - ay
            t = max(0.0, min(1.0, (px * (bx - ax) + py * (by - ay)) / n)) if n else 0.0
            d = math.hypot(px - t * (bx - ax), py - t * (by - ay))
            if d > far:
                far, at = d, i
        if at is not None and far > tolerance_m:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [i if places else points[i] for i in sorted(keep)]
