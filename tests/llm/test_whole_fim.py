"""Fill-in-middle against brute force, texts in one chunk and in many; the automaton against regular expressions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tilewright.llm import fim

SCHEMA = "doc_id long, text string, _id string, _key string, n string, form int"


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(3)
    out = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é🤣\nx", "a <P> b", "<P", "<<S>", "<S\n>", "<\nM>", "x<M>", "<P<S", "end <", "$1 \\Q <S \\E\n$"]
    for _ in range(150):
        out.append("".join(rng.choice("aé🤣 \n\n<PSM>$\\") for _ in range(rng.randrange(60))))
    for size in (1_000, 4_000, 70_000):
        out.append("".join(rng.choice("abcé \n<") for _ in range(size)))
    return out + ["x" * 70_000, "\n" * 5_000, "y" * 3_000 + "<M>" + "z" * 3_000]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_against_brute_force(spark, chunk):
    rows = list(enumerate(texts())) + [(None, "no\nid\nhere\n"), (4, "a"), (4, "another\ntext of\none id"), (30, texts()[-4]), (30, texts()[-4])]
    if chunk < 64:
        rows = [(i, t) for i, t in rows if len(t or "") < 5_000]
    df = spark.createDataFrame([(i, t, "a", "b", "c", 1) for i, t in rows], SCHEMA)
    for rate, spm in ((100, 50), (40, 10)):
        out = fim.transform(df, chunk=chunk, rate=rate, spm=spm)
        back = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back]
        assert sorted(got, key=repr) == sorted([(i, *brute(i, t, rate, spm)) for i, t in rows], key=repr)
        assert sorted([(r.doc_id, r.back) for r in back], key=repr) == sorted([(i, t or "") for i, t in rows], key=repr)
    assert {r.form for r in fim.transform(df, chunk=chunk).select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_digest_and_empty(spark):
    df = spark.createDataFrame([(i, t, "a", "b", "c", 1) for i, t in enumerate(texts())], SCHEMA)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, *brute(i, t)[:4], sha(brute(i, t)[4]), sha(t or "")) for i, t in enumerate(texts())]
    assert sorted([tuple(r) for r in fim.digest(df).collect()], key=repr) == sorted(want, key=repr)
    assert fim.digest(df.limit(0)).collect() == []


def test_functions_compose():
    """Chunks scanned from every state and composed say what the whole text's scan says, wherever it is cut."""
    rng, a = random.Random(9), fim.Automaton()
    for _ in range(200):
        text = "".join(rng.choice("ab\n<PSM>") for _ in range(rng.randrange(1, 90)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(3))
        parts = [text[x:y] for x, y in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        to, units = fim.Scan(a, text).function()
        for start in range(a.size):
            state, n = start, 0
            for part in parts:
                f, u = fim.Scan(a, part).function()
                state, n = int(f[state]), n + int(u[state])
            assert (state, n) == (int(to[start]), int(units[start]))
        ends = [m.end() for m in re.finditer("\n", text)]
        assert int(units[0]) == len(ends) and [fim.Scan(a, text).place(0, i + 1) for i in range(len(ends))] == ends
        assert bool(a.found[to[0]]) == any(m in text for m in fim.MARKERS) and bool(a.open[to[0]]) == (not text.endswith("\n"))


def test_other_markers(spark):
    markers = ("<pre>", "<suf>", "<pre><mid>")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a\nb\nc", "x <pre>", "<pre <mid>\nq", "<pr<suf>", "<pre\n><mid>"] * 4)], "doc_id long, text string")
    out = fim.transform(df, markers=markers, chunk=3).withColumn("back", fim.restored(F.col("output"), F.col("form"), markers)).join(df, "doc_id").collect()
    assert len(out) == 20 and all(r.back == r.text and (r.form == "plain") == any(m in r.text for m in markers) for r in out)
    with pytest.raises(ValueError, match="ASCII"):
        fim.Automaton(("é",))
