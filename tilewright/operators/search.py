"""Search over named places: score, candidates, top results, merging with a second source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geo, lookups, tiles

SPACE = r"[ \t\n\x0B\f\r ﻿  ]+"


def normal(text: str) -> str:
    return text.strip().lower()


def score(query: str, center: tuple[float, float] | None) -> Column:
    """Boost, more for an exact name, a name or a first word that begins with the query, less with distance."""
    norm = F.lower("name")
    s = F.col("boost") + F.when(norm == query, 100).when(F.startswith(norm, F.lit(query)), 60).otherwise(0) + F.when(F.startswith(F.split(norm, SPACE)[0], F.lit(query)), 25).otherwise(0)
    return s.cast("double") if center is None else s / (1 + geo.haversine_m(F.col("lng"), F.col("lat"), F.lit(center[0]), F.lit(center[1])) / 4000)


def candidates(docs: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Names that begin with the query, and if those are fewer than limit also names that hold it, in the order of names
    and ids, up to limit * 6 together."""
    docs = docs.withColumn("norm", F.lower("name"))
    prefix = docs.where(F.startswith("norm", F.lit(query)))
    n = prefix.limit(limit).count()
    if n >= limit:
        return prefix
    inner = docs.where(F.contains("norm", F.lit(query)) & ~F.startswith("norm", F.lit(query))).orderBy("norm", "id").limit(limit * 6 - n)
    return prefix.unionByName(inner)


def search(docs: DataFrame, text: str, center: tuple[float, float] | None = None, limit: int = 12) -> DataFrame:
    """The best documents by score, equal ones by id; none for a blank query."""
    query = normal(text)
    if not query:
        return docs.limit(0).select("id", "name", "kind", F.lit(0.0).alias("score"))
    ranked = candidates(docs, query, limit).select("id", "name", "kind", score(query, center).alias("score"))
    return ranked.orderBy(F.desc("score"), "id").limit(limit)


def merge(online: DataFrame, local: DataFrame, limit: int | None = 14, near: float = 0.02) -> DataFrame:
    """Online rows, then local ones (rank gives the order in each); a row goes if a kept one of its lower-case name is
    within `near` degrees both ways. No limit gives every row that is kept; rows without a place are near nothing.

    Kept rows decide, not all rows before. Cells are as wide as what counts as near, so a cell keeps one row at most. In
    a round the first row of a cell is kept if no row of the cells around comes before it, and what lies near kept rows
    goes; a row meets the kept ones of nine cells, however many share its name."""
    both = online.withColumn("source", F.lit(0)).unionByName(local.withColumn("source", F.lit(1)))
    norm = F.coalesce(F.concat(F.lit("="), F.lower("name")), F.lit(""))
    rows = both.select(norm.alias("_norm"), F.floor(F.col("lng") / near).alias("_cx"), F.floor(F.col("lat") / near).alias("_cy"), F.struct("source", "rank", "id", "name", "lng", "lat").alias("_r")).checkpoint()
    cell, spread = ["_norm", "_cx", "_cy"], F.array(*[F.lit(i) for i in (-1, 0, 1)])
    placed = F.col("_cx").isNotNull() & F.col("_cy").isNotNull()
    kept, rows = rows.where(~placed).select("_r"), rows.where(placed)

    def around(firsts: DataFrame) -> DataFrame:
        wide = firsts.select("_norm", F.explode(F.transform(spread, lambda i: F.col("_cx") + i)).alias("_cx"), "_cy", "_r")
        return wide.select("_norm", "_cx", F.explode(F.transform(spread, lambda i: F.col("_cy") + i)).alias("_cy"), F.col("_r").alias("_o"))

    while not rows.isEmpty():
        firsts = rows.groupBy(*cell).agg(F.min("_r").alias("_r"))
        before = around(firsts).groupBy(*cell).agg(F.min("_o").alias("_o"))
        new = firsts.join(before, cell).where(F.col("_r") == F.col("_o")).select(*cell, "_r").checkpoint()
        kept = kept.unionByName(new.select("_r")).checkpoint()
        close = lambda a, b, c: F.abs(a[f"_r.{c}"] - b[f"_o.{c}"]) < near
        by = around(new)
        rows = rows.join(by, [rows[c] == by[c] for c in cell] + [close(rows, by, "lng"), close(rows, by, "lat")], "left_anti").checkpoint()
    merged = kept.select("_r.*")
    if limit is not None:
        merged = merged.orderBy("source", "rank", "id").limit(limit)
    return merged.select("id", "name", "source")


def gated(queries: DataFrame, text: str) -> DataFrame:
    """Queries of more than one character; shorter ones aren't searched."""
    return queries.where(F.length(F.trim(text)) > 1)


#: The online source gives so many answers, and is asked round a centre of so many decimals.
ANSWERS, CENTER_DECIMALS = 12, 4


def answers(rows: DataFrame, rank: str) -> DataFrame:
    """The online source's answers to a query, as a table, in the order it gives them."""
    return rows.orderBy(rank, "id").limit(ANSWERS)


def asked_center(lng: Column, lat: Column) -> tuple[Column, Column]:
    return F.round(lng, CENTER_DECIMALS), F.round(lat, CENTER_DECIMALS)


def degraded(n_online: int, n_local: int, asked: bool) -> bool:
    """Only when the online source was asked, had nothing, and the local one had something."""
    return asked and n_online == 0 and n_local > 0


def shape_online(rows: DataFrame) -> DataFrame:
    """name (falling back to street, then city) and detail: the other parts that aren't blank or the name."""
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    name = F.coalesce(blank("name"), blank("street"), blank("city"))
    parts = F.filter(F.array("street", "city", "state", "country"), lambda p: p.isNotNull() & (F.trim(p) != "") & (p != name))
    return rows.select("id", name.alias("name"), F.array_join(parts, ", ").alias("detail"))


def put_docs(index: DataFrame, docs: DataFrame) -> DataFrame:
    """The index with docs put into it: a document of one id takes the place of the one that was there; of several new
    ones of one id the last by name and boost stays."""
    new = docs.groupBy("id").agg(F.max(F.struct(*[F.col(c) for c in ("name", "boost") if c in docs.columns], F.struct(*docs.columns).alias("_row"))).alias("_d")).select("_d._row.*")
    old = index.join(new.select("id"), "id", "left_anti")
    return old.dropDuplicates(["id"]).select(*index.columns).unionByName(new)


def remove_docs(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the documents of the given tiles."""
    return index.join(gone.select("tile").distinct(), "tile", "left_anti").select(*index.columns)


def representative(paths: Column) -> Column:
    """The middle vertex of a feature of four vertices or more, else the first; null without vertices."""
    flat = F.flatten(paths)
    n = F.size(flat)
    return F.when(n >= 4, F.get(flat, F.floor(n / 2).cast("int"))).when(n > 0, F.get(flat, F.lit(0)))


def extract(features: DataFrame) -> DataFrame:
    """Search documents (id, name, norm, kind, boost, lng, lat, tile, context) of tile features with keys source/z/x/y.

    Places at any zoom; street names, from the name layer or inline, from zoom 12, the first of each lower-case name in a
    tile's layer (by feature id and name); points of interest from zoom 14. Features without a name or a vertex have none."""
    _, z, x, y = tiles.parse_tile_key(F.col("tile"))
    text = lambda key: F.try_element_at(F.col("props"), F.lit(key))["s"]
    f = features.withColumn("z", z).withColumn("p", representative(F.col("paths"))).withColumn("name", text("name"))
    f = f.where(F.col("p").isNotNull() & (F.coalesce("name", F.lit("")) != ""))
    f = f.withColumn("cls", F.coalesce(text("class"), text("kind"))).withColumn("norm", F.lower("name"))
    lng, lat = tiles.local_to_lnglat(F.col("p.x").cast("double"), F.col("p.y").cast("double"), x, y, z, F.col("extent"))
    f = f.withColumn("lng", lng).withColumn("lat", lat)

    def docs(rows: DataFrame, mark: str, kind: Column, boost: Column, context: Column) -> DataFrame:
        return rows.select(F.concat_ws("|", "tile", F.lit(mark), "name").alias("id"), "name", "norm", kind.alias("kind"), boost.cast("int").alias("boost"), "lng", "lat", "tile", context.alias("context"))

    none = F.lit(None).cast("string")
    places = docs(f.where("layer in ('place', 'place_label', 'places')"), "p", lookups.lookup(lookups.PLACE_KIND, F.col("cls"), "hamlet"), lookups.lookup(lookups.PLACE_BOOST, F.col("cls"), 40), text("state"))
    named = f.where("layer in ('transportation_name', 'transportation', 'road', 'roads', 'streets') and z >= 12")
    columns = [F.col(c) for c in named.columns if c not in ("tile", "layer", "norm")]
    first = named.groupBy("tile", "layer", "norm").agg(F.min_by(F.struct(*columns), F.struct("id", "name")).alias("r")).select("tile", "layer", "norm", "r.*")
    streets = docs(first, "s", F.lit("street"), F.lit(25), none)
    pois = docs(f.where("layer in ('poi', 'pois') and z >= 14"), "o", F.lit("poi"), F.lit(12), none)
    return places.unionByName(streets).unionByName(pois)
