"""Queries of the search index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.derive import PLACES, derived, with_derived
from tilewright.functions import lookups
from tilewright.operators import search
from tilewright.plans.graph import checkpointed
from tilewright.plans.scalars import case, hav

QUERIES: dict = {}
ORACLE_SQL: dict = {}
C = F.col
CENTER = (-76.5, 40.1)


def register(name, build, sql=None, source="places") -> None:
    QUERIES[name] = lambda spark, sf_dir: build(derived(spark, sf_dir, source))
    if sql:
        ORACLE_SQL[name] = with_derived(sql)


def score_sql(q: str) -> str:
    return f"((boost + (case when lower(name)='{q}' then 100 when lower(name) like '{q}%' then 60 else 0 end) + (case when split_part(lower(name),' ',1) like '{q}%' then 25 else 0 end)) / (1 + {hav('lng', 'lat', *CENTER)}/4000))"


def found_sql(q: str, limit: int = 12) -> str:
    return f"(select * from places where lower(name) like '{q}%' union all select * from (select * from places where lower(name) like '%{q}%' and lower(name) not like '{q}%' and (select count(*) from places where lower(name) like '{q}%') < {limit} order by lower(name), id limit {limit * 6} - (select least(count(*),{limit}) from places where lower(name) like '{q}%')))"


r = lambda c: F.round(c, 6).alias("score")
register("sea4_score", lambda d: d.select("id", r(search.score("s", CENTER))), f"select id, round({score_sql('s')},6) as score from places")
for _i, _q in enumerate(("s", "an", "supplier#00000")):
    register(f"sea5_search_{_i}", lambda d, _q=_q: search.search(d, _q, CENTER).select("id", "name", r(C("score"))), f"select id, name, round(s,6) as score from (select id, name, {score_sql(_q)} as s from {found_sql(_q)}) order by s desc, id limit 12")
register("srt1_index_order", lambda d: d.select("id", F.lower("name").alias("norm")).orderBy("norm", "id"), "select id, lower(name) as norm from places order by norm, id")
QUERIES["srt1_index_order_whole"] = QUERIES["srt1_index_order"]
register("srt3_top_k", lambda d: d.orderBy(F.desc(search.score("s", CENTER)), "id").limit(12).select("id"), f"select id from places order by {score_sql('s')} desc, id limit 12")
register("srt4_merge_limit", lambda d: d.orderBy("id").limit(14).select("id"), "select id from places order by id limit 14")
register("set3_substring_fallback", lambda d: search.candidates(d, "an", 12).select("id"), f"select id from {found_sql('an')}")
register("sea3_kind_boost", lambda d: d.select("id", lookups.lookup(lookups.PLACE_BOOST, C("kind"), 40).alias("boost"), lookups.lookup(lookups.PLACE_KIND, C("kind"), "hamlet").alias("kind")), f"select id, {case(lookups.PLACE_BOOST, 'kind', 40)} as boost, {case(lookups.PLACE_KIND, 'kind', 'hamlet')} as kind from places")
_SHAPED = lambda d: d.select("id", F.when(C("boost") > 20, C("name")).otherwise(" ").alias("name"), C("name").alias("street"), F.lit("").alias("city"), C("kind").alias("state"), F.lit(None).cast("string").alias("country"))
register("sea7_online_rows", lambda d: search.shape_online(_SHAPED(d)), "select id, name, kind as detail from places")
register("set2_ordered_concat", lambda d: d.where("kind='poi'").select("id", F.lit(0).alias("source")).unionByName(d.where("kind='city'").select("id", F.lit(1).alias("source"))).orderBy("source", "id"), "select id, 0 as source from places where kind='poi' union all select id, 1 from places where kind='city'")

# Names from the least that begin with a prefix to before the next prefix.
register("srt2_prefix_range", lambda d: d.where((F.lower("name") >= "re") & (F.lower("name") < "rf")).select("id", "name"), "select id, name from places where lower(name) >= 're' and lower(name) < 'rf'")
_TYPED = lambda d: d.select("id", F.substring("name", F.lit(1), (F.length("name") % 4)).alias("q"))
register("sea8_query_gate", lambda d: search.gated(_TYPED(d), "q").select("id", "q"), "select id, q from (select id, substr(name, 1, cast(length(name)%4 as int)) as q from places) where length(trim(q)) > 1")
# What two sources give, each in the order of its numbers.
_RANK = lambda d: d.select("id", "name", "lng", "lat", F.substring("id", 2, 20).cast("long").alias("rank"))


def _merge_sql(online: str, limit: int) -> str:
    every = f"select id, name, lng, lat, cast(substr(id, 2) as bigint) as rank, case when {online} then 0 else 1 end as source, lower(name) as norm from places"
    near = "len(list_filter(w.kept, lambda k: abs(k.lng - r.lng) < 0.02 and abs(k.lat - r.lat) < 0.02)) > 0"
    return f"with recursive rows_ as (select *, row_number() over (partition by norm order by source, rank, id) as n from ({every})), walk(norm, n, kept, id, name, source, rank, stays) as (select norm, n, [{{'lng': lng, 'lat': lat}}], id, name, source, rank, true from rows_ where n = 1 union all select r.norm, r.n, case when {near} then w.kept else list_append(w.kept, {{'lng': r.lng, 'lat': r.lat}}) end, r.id, r.name, r.source, r.rank, not ({near}) from walk w join rows_ r on r.norm = w.norm and r.n = w.n + 1) select id, name, source from walk where stays order by source, rank, id limit {limit}"


def _merged(online: str, limit: int | None):
    return lambda d: search.merge(_RANK(d.where(online)), _RANK(d.where(f"not ({online})")), limit)


def register_merge(name: str, online: str, limit: int | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: checkpointed(spark) or _merged(online, limit)(derived(spark, sf_dir, "places"))
    sql = _merge_sql(online, limit or 1 << 40)
    ORACLE_SQL[name] = f"with recursive places as ({PLACES}), {sql.removeprefix('with recursive ')}"


register_merge("jon9_merge", "kind = 'street'", None)
register_merge("sea6_merge", "kind = 'poi'", 14)
# The second source's answers as a table: its first twelve, shaped.
register("src13_online_rows", lambda d: search.shape_online(search.answers(_SHAPED(d).withColumn("rank", F.substring("id", 2, 20).cast("long")), "rank")).select("id", "name", "detail"), "select id, name, kind as detail from places order by cast(substr(id, 2) as bigint), id limit 12")
