"""Successors of sparse ids, and near pairs where common signatures abound."""

import itertools
import random

import pytest

from tests.llm.test_operators import jaccard, sha, spot_set
from tilewright.llm import spots


def test_sparse_ids(spark):
    rng = random.Random(3)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(300)})
    rows = [(i, f"text {k} is here", k) for k, i in enumerate(ids)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    led = {r.doc_id: (r.next_doc_id, r.next_n) for r in spots.successors(df.select("doc_id", "n"), "doc_id", ["n"]).collect()}
    assert led == {i: (ids[k + 1], k + 1) if k + 1 < len(ids) else (None, None) for k, i in enumerate(ids)}
    assert spots.successors(df.limit(0).select("doc_id", "n"), "doc_id", ["n"]).count() == 0
    texts = {i: t for i, t, _ in rows}
    for r in spots.digest(df).collect():
        k = ids.index(r.doc_id)
        own, after = texts[r.doc_id], texts[ids[(k + 1) % len(ids)]]
        cut = len(own) // 4
        assert r.edited_sha256 == sha(own[: len(own) - cut] + after[:cut])


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_pairs_among_common_signatures(spark, threshold):
    rng = random.Random(7)
    common = [f"is common{i} thing{i}" for i in range(6)]
    rows = []
    for i in range(120):
        own = [f"was w{rng.randrange(25)} v{rng.randrange(3)}" for _ in range(rng.randint(0, 9))]
        rows.append((i, " . ".join(common[: rng.randint(1, 6)] + own)))
    rows += [(500, None), (501, ""), (502, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, len int, sigs string")
    ids = {r.doc_id: r.fingerprint_id for r in spots.members(df).collect()}
    sets = {ids[i]: spot_set(t or "") for i, t in rows}
    want = {tuple(sorted(p)) for p in itertools.combinations(sets, 2) if all(sets[x] for x in p) and jaccard(sets[p[0]], sets[p[1]]) >= threshold}
    assert {(r.fingerprint_id, r.near_id) for r in spots.near_pairs(df, threshold=threshold).collect()} == want and want
