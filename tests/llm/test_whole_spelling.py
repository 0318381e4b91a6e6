"""Spelling variants against brute force: all pairs one edit apart, runs subdivided to the end, chains of forms."""

import collections
import random
import re
import zlib

import pytest

from tilewright.llm import spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    n = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 5
    return {w: k for w, k in n.items() if k >= 3}


def brute(n):
    by = collections.defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    out, form = {}, {}
    for w in n:
        found = [x for k in (-1, 0, 1) for x in by[len(w) + k] if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(found)

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], out[w], n.get(form[w])) for w in n}


def as_dict(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()] + [(None, "Ärger ärger Ärger weather Weather WEATHER wéather"), (-1, None), (-2, ""), (-3, "a1b2 straße Straße STRAßE ÷×÷×÷ " * 3), (-3, "weather " * 30)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, word string, run string, n long")
    want = brute(brute_words(rows))
    assert len(want) > 500 and sum(v[0] is not None for v in want.values()) > 10
    assert as_dict(spelling.digest(df)) == want
    assert spelling.digest(df.limit(0)).collect() == []


@pytest.mark.parametrize("run", [1, 3, 64])
def test_dense_words(spark, run):
    """Words of few letters are in large runs, with many places for one insertion."""
    rng = random.Random(run)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(260)}
    words |= {"x" * i for i in range(1, 30)} | {"prefix" + "".join(rng.choice("abcé🤣") for _ in range(4)) for _ in range(150)}
    n = {w: rng.randrange(1, 40) for w in words}
    df = spark.createDataFrame(list(n.items()) + [(None, 5), ("", 2)], "word string, n long")
    pairs = spelling.near_words(df.where("word is not null"), run).collect()
    got = [tuple(sorted((r.a, r.b))) for r in pairs]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in n for b in n if a < b and near(a, b)}
    assert all((r.a_n, r.b_n) == (n[r.a], n[r.b]) for r in pairs)
    assert {w: v for w, v in as_dict(spelling.variants(df, run=run)).items() if w} == brute(n)


def test_long_chains(spark):
    """Forms of forms, as many as counts allow, and ties by code points."""
    words = {"b" * 5 + "é" * i: 2**i for i in range(40)} | {"zzzzz": 3, "zzzzy": 7, "zzzzx": 7, "zzzzé": 7}
    got = as_dict(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words)
    assert got["bbbbb"][1] == "bbbbb" + "é" * 39 and got["zzzzz"][0] == "zzzzx"
    with pytest.raises(ValueError, match="twice"):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"), times=1)
