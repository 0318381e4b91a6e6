"""The stream's sink: batches, a batch that broke off and one that is run again leave one version a key."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.streaming import sinks

SCHEMA = "k string, v long, at long"


def batches():
    rng = random.Random(3)
    return [[(rng.choice([None, *(f"k{i}" for i in range(40))]), rng.randrange(1000), 100 * b + i) for i in range(rng.randrange(1, 60))] for b in range(4)]


def after(parts):
    out = {}
    for k, v, at in (r for p in parts for r in p):
        if k not in out or at > out[k][1]:
            out[k] = (v, at)
    return {(k, *v) for k, v in out.items()}


def now(spark, folder):
    rows = [tuple(r) for r in sinks.stored(spark, folder, SCHEMA).collect()]
    assert len(rows) == len(set(r[0] for r in rows))
    return set(rows)


def test_batches_break_off_and_repeat(spark, tmp_path, monkeypatch):
    folder, parts = str(tmp_path / "store"), batches()
    put = lambda i: sinks.upsert(spark.createDataFrame(parts[i], SCHEMA), i, folder, "k", ["at"], 8)
    assert now(spark, folder) == set()
    put(0)
    put(1)
    assert now(spark, folder) == after(parts[:2])
    # It breaks off when its rows are written and its list isn't.
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda self, data, *a, _old=type(spark).createDataFrame, **b: (_ for _ in ()).throw(RuntimeError("lost")) if data and len(data[0]) == 2 else _old(self, data, *a, **b))
        with pytest.raises(RuntimeError, match="lost"):
            put(2)
    assert now(spark, folder) == after(parts[:2])
    put(2)
    put(2)
    assert now(spark, folder) == after(parts[:3])
    # The last batch again with other rows, as if it had been cut otherwise: it takes the place of what it was.
    sinks.upsert(spark.createDataFrame(parts[3], SCHEMA), 2, folder, "k", ["at"], 8)
    assert now(spark, folder) == after([*parts[:2], parts[3]])


def test_stream(spark, tmp_path):
    parts, folder = batches(), str(tmp_path / "out")
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = lambda: source.where(F.lit(True)).writeStream.foreachBatch(sinks.into(folder, "k", ["at"], 8)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)
    run()
    run()
    assert now(spark, folder) == after(parts) and len(sinks._lists(spark, folder)) >= 4
