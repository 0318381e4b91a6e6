"""Position fixes as a table or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FIX = "trip_id long, event_id long, ts timestamp, lng double, lat double, accuracy double"


def read(spark: SparkSession, path: str, schema: str | StructType = FIX) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream(spark: SparkSession, path: str, schema: str | StructType = FIX, files_a_batch: int = 100) -> DataFrame:
    """New files under the path as they appear, so many in a batch at most; files already there come first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
