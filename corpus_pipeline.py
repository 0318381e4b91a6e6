"""Corpus pipeline over `documents`: quality classifier, n-gram Jaccard join, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and
returns the columns of documents (the last: the packing). Rows with null ids or texts, repeated
rows and further columns go through the stages as the operators' docstrings say."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tilewright.llm import near, packing, pii, quality
from tilewright.llm.common import checkpoint_dir, drop_scratch, quoted, scratch_scope, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label model rejects go; null, empty and blank texts are among them."""
    return quality.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near equal texts the one with the least id stays; texts without words stay.

    Null ids come after all others. Where ids repeat, texts tell rows apart: of a linked group one text stays. Of rows
    with one id and text the least by its further columns stays (by their JSON where a type has no order)."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    linked = near.link(docs.select(own.alias("_row"), "text"), "_row").where(F.col("_row") == F.col("component_id"))
    linked = linked.select(F.col("_row.id").alias("_id"), F.col("_row.h").alias("_h")).distinct()
    # Further columns go along in one, in which no name can clash.
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in rest]).alias("rest"), F.struct(F.lit(0).alias("_"), *[_ordered(docs, c).alias(f"_{i}") for i, c in enumerate(rest)]).alias("order"))
    kept = rows.join(linked, F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("t") == F.col("_h")), "left_semi")
    one = kept.groupBy("id", "t").agg(F.min_by("rest", "order").alias("rest"))
    return one.select(*[F.col({"doc_id": "id", "text": "t"}.get(c) or f"rest.{quoted(c)}").alias(c) for c in docs.columns])


def _ordered(docs: DataFrame, name: str) -> Column:
    """The column, or its JSON where its type has no order: maps, and what holds them."""
    return F.col(quoted(name)) if _has_order(docs.schema[name].dataType) else F.to_json(F.struct(F.col(quoted(name))))


def _has_order(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_has_order(f.dataType) for f in kind)
    return _has_order(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away become their kind or class in brackets; n_chars follows the text."""
    clean = pii.sanitise(docs, by_class=True)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return clean.select(*[F.col(quoted(c)) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets and batches of every document left."""
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", deduplicate), ("personal data", remove_personal_data), ("packing", pack)]

#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again; what a stage needed on the way goes."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch_scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}")
        if i:
            drop_scratch(spark, f"{base}/{i - 1}")
    return docs
