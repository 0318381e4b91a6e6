"""Running sums over one global order without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_sum(df: DataFrame, order: list[str], value: str, bucket, out: str) -> DataFrame:
    """Adds the sum of value over all rows before, in the order. bucket is an expression that grows with the first
    order column: sums inside buckets are one window each, and what lies before a bucket comes from the bucket totals."""
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy("_bucket").agg(F.sum(value).alias("_t"))
    before = totals.select("_bucket", (F.sum("_t").over(Window.orderBy("_bucket")) - F.col("_t")).alias("_before"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inner", inner).join(before, "_bucket").withColumn(out, F.col("_inner") + F.col("_before")).drop("_bucket", "_inner", "_before")
