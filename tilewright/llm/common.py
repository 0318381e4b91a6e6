"""Shared plumbing of the operators: table access, shared scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local master's session names no folder (tests, laptops).
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"
#: Scratch tables that are still there, by the scopes that will drop them.
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as it stands in expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; set here only where unset, on a local master."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINT_DIR)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def drop_scratch(spark: SparkSession, path: str | None) -> None:
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are dropped at its end: results must have been written or read by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_scratch(spark, path)


def null_safe_key(*cols: str):
    """A digest of the columns in which null, empty and shifted values differ."""
    parts = [F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in cols]
    return F.md5(F.concat(*parts))
