"""Packing end to end against the least padding of all choices of boundaries; long texts' lengths are exact too."""

import itertools
import random

from tilewright.llm import packing


def test_least_padding_of_all(spark, monkeypatch):
    rng = random.Random(3)
    for dense in (1, 4096):
        monkeypatch.setattr(packing, "DENSE", dense)
        sizes = [rng.choice([0, 1, 2, 7, 40, 41, 300, 1500, 1501, 4099]) for _ in range(60)]
        rows = [(i, " ".join(["w"] * n)) for i, n in enumerate(sizes)] + [(None, None), (3, "a b"), (3, "a b")]
        sizes += [0, 2, 2]
        df = spark.createDataFrame([(i, t, 7, 7) for i, t in rows], "doc_id long, text string, bucket int, _h long")
        kinds = sorted(set(sizes))
        pad = lambda bounds: sum(min(b for b in bounds if b >= n) - n for n in sizes)  # noqa: B023, E731
        for k in (1, 3):
            out = packing.pack(df, buckets=k, budget=5000).collect()
            assert len(out) == len(rows) and {r.padded for r in out} <= set(kinds)
            assert sum(r.padding for r in out) == min(pad([*s, kinds[-1]]) for s in itertools.combinations(kinds[:-1], k - 1))
            assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in out) == sorted((i is None, i or 0, n) for (i, _), n in zip(rows, sizes, strict=True))
            assert len({(r.bucket, r.batch, r.slot) for r in out}) == len(rows)


def test_text_is_read_once(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = packing.pack(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and "text" not in plan
