"""Stages of the pipeline on repeated ids, clashing columns and empty tables; the classifier's decisions take effect."""

import corpus_pipeline
from tilewright.llm import quality

SF = "/root/testdata/sf0.001"
WORDS = "one two three four five six seven eight nine ten"


def test_repeated_ids(spark):
    a, b = f"A {WORDS} alone", f"B {WORDS.upper()} {WORDS} twice"
    rows = [(3, b, "x", 1), (5, a, "y", 2), (5, b, "z", 3), (5, a, "a", 9), (None, b, "n", 1), (None, "not like the others at all", "n", 1), (7, None, "e", 1), (8, "", "e", 1), (8, "", "d", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _row int")
    out = corpus_pipeline.deduplicate(spark, df, SF)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=repr) == sorted([(3, b, "x", 1), (5, a, "a", 9), (None, "not like the others at all", "n", 1), (7, None, "e", 1), (8, "", "d", 2)], key=repr)
    assert corpus_pipeline.deduplicate(spark, df.limit(0), SF).count() == 0


def test_classifier_keeps_what_the_digest_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id for r in quality.digest(docs).collect() if r.keep}
    out = corpus_pipeline.classify(spark, docs, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == want and 0 < len(want) < docs.count() and out.columns == docs.columns


def test_clashing_columns_reach_the_end(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "spans").withColumnRenamed("lang", "base")
    out = corpus_pipeline.remove_personal_data(spark, docs, SF)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.spans for r in out.select("spans").distinct().collect()} == {r.spans for r in docs.select("spans").distinct().collect()}
    assert corpus_pipeline.pack(spark, out, SF).count() == docs.count()


def test_em_and_posteriors_against_brute_force():
    """Expectation-maximisation over packed votes, against the same steps row by row."""
    import numpy as np

    rng = np.random.default_rng(5)
    truth = rng.random(400) < 0.6
    accuracy = np.array([0.9, 0.7, 0.8])
    votes = np.where(rng.random((400, 3)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = quality.NONE
    codes = [sum(int(v) * 3 ** (2 - i) for i, v in enumerate(row)) for row in votes]
    u, n = np.unique(codes, return_counts=True)
    posterior, table, prior = quality.em(u, n, 3)
    # A fixed point: one more pass over the rows with these tables gives the same posteriors and prior.
    again = []
    for row in votes:
        good = prior * np.prod([table[i, 1, v] for i, v in enumerate(row)])
        bad = (1 - prior) * np.prod([table[i, 0, v] for i, v in enumerate(row)])
        again.append(good / (good + bad))
    assert np.abs(np.array([posterior[c] for c in codes]) - again).max() < 1e-3
    assert abs(np.mean(again) - prior) < 2e-2


def test_names_that_clash_inside_the_stages(spark):
    """Columns named like the stages' own, with dots and backticks, and of types without an order."""
    a = f"{WORDS} and so on until the end of it, mail me: some.one@mail.org"
    schema = "doc_id long, text string, _id string, _h long, `a.b` int, `c``d` string, rest map<string,int>, `order` struct<m: map<string,int>>, id array<map<string,int>>, t binary, row int, n_chars int, component_id int"
    rows = [(i, f"{a} {i // 2}" if i < 6 else None, "x", i % 2, i, "y", {"k": i}, ({"k": 1},), [{"k": 2}], b"b", 1, 3, 4) for i in (0, 1, 2, 2, 3, 4, 5, 6, 6)]
    df = spark.createDataFrame(rows, schema)
    for stage in (corpus_pipeline.classify, corpus_pipeline.deduplicate, corpus_pipeline.remove_personal_data):
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.schema == df.schema
        assert len(out.collect()) == {"classify": 0, "deduplicate": 2, "remove_personal_data": len(rows)}.get(stage.__name__) or stage is corpus_pipeline.classify
    got = corpus_pipeline.deduplicate(spark, df, SF).orderBy("doc_id").collect()
    assert [(r.doc_id, r["a.b"], r["c`d"], r.rest, r.order.m, r.id) for r in got] == [(0, 0, "y", {"k": 0}, {"k": 1}, [{"k": 2}]), (6, 6, "y", {"k": 6}, {"k": 1}, [{"k": 2}])]
    assert all("@" not in (r.text or "") for r in corpus_pipeline.remove_personal_data(spark, df, SF).collect())
    assert corpus_pipeline.pack(spark, df, SF).count() == len(rows)
