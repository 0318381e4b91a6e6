"""The tile store as a table: upserts, pins, areas, and eviction under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geo, tiles
from tilewright.operators.prefix import running_sum
from tilewright.operators.routes import project_onto_path


def usage(metas: DataFrame) -> DataFrame:
    """Bytes and tiles by tier."""
    return metas.groupBy("tier").agg(F.sum("size").alias("bytes"), F.count("*").alias("tiles"))


def pressure(metas: DataFrame, budget: int) -> DataFrame:
    used = metas.agg(F.coalesce(F.sum(F.when(F.col("tier") == "smart", F.col("size"))), F.lit(0)).alias("used"))
    ratio = F.col("used") / budget if budget > 0 else F.lit(0.0)
    return used.withColumn("pressure", F.when(ratio > 1, "critical").when(ratio > 0.85, "high").otherwise("ok"))


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each key, by access and then id, as one aggregate that combines before the shuffle."""
    last = F.max_by(F.struct("size", "tier", "last_access"), F.struct("last_access", "tile_id"))
    return rows.groupBy("k").agg(last.alias("r")).select("k", "r.*")


def pin(metas: DataFrame, keys: DataFrame, owner: str) -> DataFrame:
    """Smart tiles of the given distinct keys are pinned; others stay as they are."""
    wanted = metas.join(keys.withColumn("_wanted", F.lit(True)), "k", "left")
    return wanted.select("tile_id", F.when((F.col("tier") == "smart") & F.col("_wanted"), owner).otherwise(F.col("pinned_by")).alias("pinned_by"))


def unpin(metas: DataFrame, owner: str) -> DataFrame:
    return metas.select("tile_id", F.when(F.col("pinned_by") == owner, F.lit(None)).otherwise(F.col("pinned_by")).alias("pinned_by"))


def areas(metas: DataFrame) -> DataFrame:
    """Areas of the tiles' columns: id, tile_keys, bytes."""
    return metas.groupBy(F.concat(F.lit("area-"), F.col("x").cast("string")).alias("id")).agg(F.collect_set("k").alias("tile_keys"), F.sum("size").alias("bytes"))


def delete_area(metas: DataFrame, all_areas: DataFrame, area: str) -> DataFrame:
    """Tiles that are left when an area goes with all its tiles."""
    gone = all_areas.where(F.col("id") == area).select(F.explode("tile_keys").alias("k"))
    return metas.join(gone, "k", "left_anti")


def cache_first(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted keys with the stored size; a missing or empty tile is no hit."""
    have = stored.groupBy("k").agg(F.max("size").alias("size"))
    return wanted.join(have, "k", "left").select("k", "size", F.coalesce(F.col("size") > 0, F.lit(False)).alias("hit"))


def evict(metas: DataFrame, budget: int, protected: Column | None = None) -> DataFrame:
    """Smart tiles to delete, oldest first and then by id, until the rest fits into nine tenths of the budget.

    A tile goes if what is in use, less all that goes before it, is over the target."""
    target = int(budget * 0.9)
    smart = metas.where(F.col("tier") == "smart")
    used = smart.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("u")).collect()[0].u
    if used <= target:
        return smart.limit(0)
    free = smart if protected is None else smart.where(~F.coalesce(protected, F.lit(False)))
    return running_sum(free, ["last_access", "tile_id"], "size", F.to_date("last_access"), "before").where(F.lit(used) - F.col("before") > target)


def protected(metas: DataFrame, route: list[tuple[float, float]], along_m: float, corridor_m: float, keep_behind_m: float) -> DataFrame:
    """metas with `protected`: pinned, the centre in the corridor of the route, and no further behind along_m than that.

    However many rows a tile has, its centre is projected once."""
    lng, lat = tiles.tile_center(F.col("x"), F.col("y"), F.col("z"))
    near = lambda p: (p["dist_m"] <= corridor_m) & (p["along_m"] >= along_m - keep_behind_m)
    inside = metas.where("pinned_by is not null").select("z", "x", "y").distinct().select("z", "x", "y", once(project_onto_path(lng, lat, route), near).alias("_inside"))
    return metas.join(inside, ["z", "x", "y"], "left").withColumn("protected", F.col("pinned_by").isNotNull() & F.coalesce("_inside", F.lit(False))).drop("_inside")


def trim(rows: DataFrame, most: int, down_to: int) -> DataFrame:
    """Over `most` rows only the `down_to` newest stay."""
    if rows.limit(most + 1).count() <= most:
        return rows.select("tile_id")
    return rows.orderBy(F.desc("last_access"), F.desc("tile_id")).limit(down_to).select("tile_id")


def settings(rows: DataFrame, owner: str) -> DataFrame:
    """(owner, name, value) of rows (owner, layer, name, value): of each owner's settings the value of the highest layer,
    such as a preset over what was saved over the defaults; null values are not set."""
    return rows.where("value is not null").groupBy(owner, "name").agg(F.max_by("value", "layer").alias("value"))


def fetched(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """The store (k, size, tier) after tiles (k, size) came in: what is null (offline) or empty is turned away, the rest
    replaces what was there as a smart tile. Of several arrivals of a key the largest counts."""
    new = arrived.where(F.col("size") > 0).groupBy("k").agg(F.max("size").alias("new"))
    both = stored.select("k", "size", "tier").join(new, "k", "full")
    return both.select("k", F.coalesce("new", "size").alias("size"), F.when(F.col("new").isNotNull(), "smart").otherwise(F.col("tier")).alias("tier"))


def fetch_stats(arrived: DataFrame) -> DataFrame:
    """Tiles (k, size) that came, those that came empty or not at all (null), and the bytes."""
    return arrived.agg(F.count_if(F.col("size") > 0).alias("stored"), F.count_if(F.coalesce("size", F.lit(0)) <= 0).alias("failed"), F.sum("size").alias("bytes"))


def min_zoom(groups: DataFrame, loaded: DataFrame, by: str) -> DataFrame:
    """(by, z): the least zoom of each group's loaded tiles, 99 for a group without any."""
    least = loaded.groupBy(by).agg(F.min("z").alias("z"))
    return groups.join(least, by, "left").select(by, F.coalesce("z", F.lit(99)).alias("z"))


def n_tiles_in_bbox(box: tuple[Column, Column, Column, Column], z: Column) -> Column:
    """Number of tiles of zoom z that a box (west, south, east, north) meets."""
    top = tiles.n_tiles(z).cast("long") - 1
    rows = F.least(tiles.tile_y(box[1], z).cast("long"), top) - F.greatest(tiles.tile_y(box[3], z).cast("long"), F.lit(0)) + 1
    return (tiles.tile_x(box[2], z) - tiles.tile_x(box[0], z) + 1).cast("long") * F.greatest(rows, F.lit(0).cast("long"))


#: The first pass of a plan: zooms by the direct distance, and how many tiles it may take.
COARSE = [(150_000.0, 11), (40_000.0, 12), (0.0, 13)]
COARSE_LEAST, COARSE_CAP = 8, 900


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def coarse_zoom(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """struct(z, tiles, ok) of a trip's first pass: by distance, then down to COARSE_LEAST until no more than COARSE_CAP
    tiles cover the trip's padded box; not ok if they are three times as many even so."""

    def tried(direct: Column) -> Column:
        box = geo.pad_bbox(F.least(lng1, lng2), F.least(lat1, lat2), F.greatest(lng1, lng2), F.greatest(lat1, lat2), F.greatest(F.lit(3000.0), direct * 0.08))
        start = F.when(direct > COARSE[0][0], COARSE[0][1]).when(direct > COARSE[1][0], COARSE[1][1]).otherwise(COARSE[2][1])
        # The box as shares of the world; a zoom's tiles are these times its size.
        world = F.struct(tiles.world_x(box[0]).alias("w"), tiles.world_y(box[1]).alias("s"), tiles.world_x(box[2]).alias("e"), tiles.world_y(box[3]).alias("n"), start.alias("start"))
        return once(world, counted)

    def counted(b: Column) -> Column:
        def at(z: Column) -> Column:
            size = tiles.n_tiles(z)
            tile = lambda v: F.floor(b[v] * size).cast("long")
            rows = F.least(tile("s"), size.cast("long") - 1) - F.greatest(tile("n"), F.lit(0)) + 1
            return F.struct(z.alias("z"), ((tile("e") - tile("w") + 1) * F.greatest(rows, F.lit(0))).alias("tiles"))

        tries = F.transform(F.sequence(b["start"], F.lit(COARSE_LEAST), F.lit(-1)), at)
        return F.filter(tries, lambda t: (t["tiles"] <= COARSE_CAP) | (t["z"] == COARSE_LEAST))[0]

    return once(once(geo.haversine_m(lng1, lat1, lng2, lat2), tried), lambda f: F.struct(f["z"].alias("z"), f["tiles"].alias("tiles"), (f["tiles"] <= COARSE_CAP * 3).alias("ok")))


#: An area for download may have so many tiles of zooms from AREA_FROM on.
AREA_FROM, AREA_MOST = 4, 6000


def area_guard(wanted: DataFrame) -> DataFrame:
    """Areas (id, west, south, east, north, max_zoom) with the number of their tiles and whether these are few enough."""
    box = (F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    counts = F.transform(F.sequence(F.lit(AREA_FROM), F.col("max_zoom")), lambda z: n_tiles_in_bbox(box, z))
    total = F.when(F.col("max_zoom") >= AREA_FROM, F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)).otherwise(F.lit(0).cast("long"))
    return wanted.withColumn("n", total).withColumn("ok", F.col("n") <= AREA_MOST)


def area_download(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, z, x, y, action) of the tiles of the areas that area_guard lets pass: fetch what isn't stored (k, size, tier)
    or is empty, upgrade smart tiles to permanent ones, keep the rest. An area has AREA_MOST tiles at most. Of the largest
    rows of a key that with the smallest tile_id counts, if there is one."""
    box = (F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    each = area_guard(wanted).where("ok").withColumn("z", F.explode(F.sequence(F.lit(AREA_FROM), F.col("max_zoom")))).withColumn("t", F.explode(tiles.tiles_in_bbox(*box, F.col("z"))))
    each = each.select("id", "z", "t.x", "t.y").withColumn("k", tiles.tile_key(F.lit("planet"), F.col("z"), F.col("x"), F.col("y")))
    have = stored.groupBy("k").agg(F.max("size").alias("size"), F.max_by("tier", F.struct("size", *[-F.col(c) for c in ("tile_id",) if c in stored.columns])).alias("tier"))
    action = F.when(F.coalesce("size", F.lit(0)) <= 0, "fetch").when(F.col("tier") == "smart", "upgrade").otherwise("keep")
    return each.join(have, "k", "left").select("id", "z", "x", "y", action.alias("action"))


def without_coarse(metas: DataFrame, route: list[tuple[float, float]], max_zoom: int, keep_m: float) -> DataFrame:
    """Tiles of zooms above max_zoom, and those of lower zooms whose centre is within keep_m of the route."""
    x, y = tiles.tile_center(F.col("x"), F.col("y"), F.col("z"))
    return metas.where((F.col("z") > max_zoom) | (project_onto_path(x, y, route)["dist_m"] <= keep_m))


def center_distance(lng: float, lat: float) -> Column:
    x, y = tiles.tile_center(F.col("x"), F.col("y"), F.col("z"))
    return geo.haversine_m(x, y, F.lit(lng), F.lit(lat))
