"""Labels, scores and spans of license texts against brute force over words, edited and embedded."""

import collections
import random

from tilewright.llm import licenses


def brute(text):
    """(label, first, end, score) of the best spans."""
    words, out = licenses.words_of(text), []
    k, drift = licenses.K, licenses.DRIFT
    for label, template in licenses.TEMPLATES:
        said = licenses.words_of(template)
        at = collections.defaultdict(list)
        for t in range(len(said) - k + 1):
            at[tuple(said[t : t + k])].append(t)
        votes = collections.defaultdict(set)
        for p in range(len(words) - k + 1):
            for t in at.get(tuple(words[p : p + k]), ()):
                votes[p - t].add(t)
        for d in votes:
            near = [(e, t) for e in votes if d <= e <= d + drift for t in votes[e]]
            first, end = min(e + t for e, t in near), max(e + t for e, t in near) + k
            covered = {t + j for _, t in near for j in range(k)}
            score = len(covered) / max(len(said), end - first)
            if score >= licenses.LEAST:
                out.append((label, first, end, score))
    return [s for s in out if s[3] == max(r[3] for r in out if abs(r[1] - s[1]) <= drift)]


def test_against_brute_force(spark):
    rng = random.Random(12)
    noise = lambda n: " ".join(rng.choice(["the", "software", "and", "license", "of", "w1", "w2", "granted"]) for _ in range(n))
    rows = []
    for i in range(150):
        _, text = rng.choice(licenses.TEMPLATES)
        words = text.split()
        for _ in range(rng.randrange(4)):
            j = rng.randrange(len(words))
            words[j : j + rng.randrange(2)] = [rng.choice(["changed", "word", words[j]])]
        rows.append((i, f"{noise(rng.randrange(30))} {' '.join(words)} {noise(rng.randrange(30))}"))
    rows += [(900 + i, f"{noise(5)} {t} {noise(3)} {t}") for i, (_, t) in enumerate(licenses.TEMPLATES)] + [(1000, None), (1001, ""), (None, licenses.TEMPLATES[0][1])]
    out = licenses.scan(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, spans int, label string")).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        want = brute(texts[r.doc_id] or "")
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == {s[0] for s in want} | base, r
        assert r.spans == ",".join(sorted({f"{s[0]}:{s[1]}:{s[2]}" for s in want}))
        assert abs(r.score - max([s[3] for s in want] + [1.0] * bool(base) + [0.0])) < 1e-12
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        got = next(r for r in out if r.doc_id == 900 + i)
        assert label in got.labels.split(",") and len(set(got.labels.split(",")) - set(got.base_labels.split(","))) <= 1


def test_one_changed_word(spark):
    text = "This is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License"
    rows = [(0, text), (1, text.replace("ShareAlike 3.0", "NonCommercial 4.0")), (2, text.replace("-ShareAlike 3.0", " 4.0"))]
    out = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: "cc-by-sa", 1: "cc-by-nc", 2: "cc-by"}
