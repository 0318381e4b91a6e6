"""The tile store as the sink of a stream: upserts by batch, in files by key range of hashes, one version a key.

A batch rewrites only the ranges that it touches, into a folder of its own, and then writes which
folder each range is in. That list is one small table a batch, and a reader takes the last complete
one: until it is there the batch has changed nothing, and a batch that is run again starts from the
list before it and replaces its own files. Streams repeat batches under their old numbers, so each
counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Ranges of a store; a batch reads and writes those of its keys.
RANGES = 64
LISTED = "range int, batch long"


def _lists(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose lists are complete."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/lists")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(path) if fs.exists(path) else []
    return sorted(int(f.getPath().getName()) for f in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))


def _list(spark: SparkSession, folder: str, batch: int | None) -> DataFrame:
    return spark.createDataFrame([], LISTED) if batch is None else spark.read.schema(LISTED).parquet(f"{folder}/lists/{batch}")


def _rows(spark: SparkSession, folder: str, schema: StructType | str, places: list[tuple[int, int]]) -> DataFrame:
    """Rows of ranges in their batches' folders."""
    files = [f"{folder}/rows/{batch}/range={r}" for r, batch in places]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def stored(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The store's rows after its last complete batch."""
    done = _lists(spark, folder)
    places = [(r.range, r.batch) for r in _list(spark, folder, done[-1] if done else None).collect()]  # RANGES rows at most
    return _rows(spark, folder, schema, places)


def upsert(new: DataFrame, batch: int, folder: str, key: str, version: list[str], ranges: int = RANGES) -> None:
    """Puts a batch's rows into the store: of each key the row of the largest version stays, of equal ones any. A store
    keeps its number of ranges. Null keys share a range."""
    spark, columns = new.sparkSession, new.columns
    before = [b for b in _lists(spark, folder) if b < batch]
    known = {r.range: r.batch for r in _list(spark, folder, before[-1] if before else None).collect()}
    own = new.withColumn("range", F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int"))
    touched = sorted(r.range for r in own.select("range").distinct().collect())
    old = _rows(spark, folder, new.schema, [(r, known[r]) for r in touched if r in known]).withColumn("range", F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int"))
    last = F.max_by(F.struct(*columns), F.struct(*version))
    merged = own.unionByName(old).groupBy("range", key).agg(last.alias("_r")).select("range", "_r.*")
    merged.repartition("range").write.mode("overwrite").partitionBy("range").parquet(f"{folder}/rows/{batch}")
    places = known | dict.fromkeys(touched, batch)
    spark.createDataFrame(sorted(places.items()), LISTED).coalesce(1).write.mode("overwrite").parquet(f"{folder}/lists/{batch}")


def into(folder: str, key: str, version: list[str], ranges: int = RANGES) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch."""
    return lambda rows, batch: upsert(rows, batch, folder, key, version, ranges)
