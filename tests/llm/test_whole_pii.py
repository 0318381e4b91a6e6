"""Disclosing terms at the default threshold and window against brute force, and columns with clashing names."""

import collections
import math
import random

import pytest
import regex

from tests.llm.test_operators import PATTERNS, valid
from tilewright.llm import pii

TERM = regex.compile(r"[\p{L}\p{N}]{2,}")


def spans_of(text):
    return sorted((m.start(), n, m.end(), m[0]) for n, (k, p) in enumerate(PATTERNS.items()) for m in regex.finditer(p, text) if valid(k, m[0]))


def around(text, a, b):
    left, right = max(0, a - pii.WINDOW - 1), min(len(text), b + pii.WINDOW + 1)
    x, y = text[left:a], text[b:right]
    x = regex.sub(r"^[\p{L}\p{N}]+", "", x) if left else x
    y = regex.sub(r"[\p{L}\p{N}]+$", "", y) if right < len(text) else y
    return set(TERM.findall(f"{x} {y}".lower()))


def keys_of(k, v):
    digits = "".join(c for c in v if c.isdigit())
    group = ["@" + v.lower().rsplit("@", 1)[-1], ".".join(v.split(".")[:2]) + ".*", digits[:6] + "*", "+" + digits[:-7] + "*"][k]
    return f"{k}:{v.lower()}", f"{k}:~{group}"


def brute(texts):
    n_e, n_t, n_et = collections.Counter(), collections.Counter(), collections.Counter()
    docs = {t for t in texts if t}
    for t in docs:
        with_e = collections.defaultdict(set)
        for a, k, b, v in spans_of(t):
            for e in keys_of(k, v):
                with_e[e] |= around(t, a, b)
        n_e.update(with_e.keys())
        n_et.update((e, w) for e, ws in with_e.items() for w in ws)
        n_t.update(set(TERM.findall(t.lower())))
    n = len(docs)
    return {(e, t) for (e, t), c in n_et.items() if c >= pii.SUPPORT and n > n_e[e] and math.log(n * c / (n_e[e] * n_t[t])) >= pii.SHARE * math.log(n / n_e[e]) - 1e-12}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"wörd{i}" for i in range(120)]
    people = [(f"Name{i}", f"mail.{i}@host{i % 3}.org", f"10.0.0.{i}", f"+1 (243) 555-1{i:03}") for i in range(12)]
    out = []
    for i in range(160):
        name, mail, ip, phone = people[i % 12]
        body = [" ".join(rng.choices(words, k=rng.randint(3, 60))) for _ in range(3)]
        k = rng.randrange(4)
        out.append("\n".join([body[0], f"{name}{'xyz '[k]} {1000 + 3 * i // 36 + k}", [mail, ip, phone, "none"][k], *body[1:]]))
    return out + out[:9] + ["", None, "mail.1@host1.org", "Name1 alone", "x" * 500 + " a@b.cd " + "y" * 500]


def test_against_brute_force(spark, texts):
    want = brute(texts)
    assert len(want) > 10
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])], "doc_id long, text string")
    assert {(r.entity, r.term) for r in pii.disclosing(df, groups=True).collect()} == want
    assert {(r.entity, r.term) for r in pii.disclosing(df).collect()} == {(e, t) for e, t in want if e[2] != "~"}
    terms = collections.defaultdict(set)
    for e, t in want:
        terms[e].add(t)
    out = pii.digest(df).collect()
    assert len(out) == df.count()
    for r in out:
        text = (texts[r.doc_id if r.doc_id is not None else 0]) or ""
        base = spans_of(text)
        own = set().union(*(terms[e] for _, k, _, v in base for e in keys_of(k, v)))
        found = [(m.start(), 4, m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", text) if m[0].lower() in own and not any(m.start() < b and a < m.end() for a, _, b, _ in base)]
        every = sorted([(a, k, b) for a, k, b, _ in base] + found)
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in every) and r.n_terms == len(found)
    assert sum(r.n_terms for r in out) > 50


def test_clashing_columns(spark, texts):
    rows = [(i, t, "kept", i, i, "r", "x", 1, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, base long, k long, row string, t string, _terms long, terms string")
    out = pii.sanitise(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r[0]][2:] == r[2:] and (got[r[0]].text is None) == (r[1] is None)
    assert any("[TERM]" in (r.text or "") and "[NUMBER]" not in r.text for r in got.values())
    assert not any(spans_of(r.text or "") for r in got.values())
    both = pii.annotate(df)
    assert [c for c in both.columns if c == "spans"] == ["spans"] and both.count() == len(rows)


def test_one_text_proves_nothing(spark):
    """A rare word next to an address is no evidence in one text or in its copies; in two texts of an entity or its group it is."""
    filler = [" ".join(f"w{i * 7 + j}" for j in range(40)) for i in range(30)]
    alone = f"{filler[0]} Onlyhere a@one.org {filler[1]}"
    twice = [f"{filler[4]} Twice Room7b 4711 and e@three.org {filler[5]}", f"{filler[6]} {filler[7]} by Twice room7b 4711: e@three.org {filler[8]}"]
    hosts = [f"{filler[9]} company x@four.org {filler[10]}", f"{filler[11]} company y@four.org {filler[12]}"]
    df = spark.createDataFrame(list(enumerate([alone, alone, *twice, *hosts, *filler])), "doc_id long, text string")
    assert {r.term for r in pii.disclosing(df).collect()} == {"twice", "room7b", "4711"}
    assert {r.term for r in pii.disclosing(df, groups=True).collect()} == {"twice", "room7b", "4711", "company"}
    got = {r.doc_id: r.text for r in pii.sanitise(df, by_class=True).collect()}
    assert "Onlyhere [EMAIL]" in got[0] and got[0] == got[1]
    assert "[NAME] [CODE] [NUMBER] and [EMAIL]" in got[2] and "by [NAME] [CODE] [NUMBER]: [EMAIL]" in got[3]
    assert "[TERM] [EMAIL]" in got[4] and "[TERM] [EMAIL]" in got[5]
