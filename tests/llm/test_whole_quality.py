"""The eleven labellers, the hashed features, the fit and the scores against plain loops over single texts."""

import math
import random
import re

import numpy as np

from tilewright.llm import quality
from tilewright.llm.wordhash import SPACE_SEPARATORS, Tokenizer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = random.Random(12)


def texts():
    out = ["", " \n\t", "a", "!", "the the the the", "Hello there. " * 30, "!!! " * 20, "# $ % & *" * 9, "WHAT A LOUD TEXT! " * 5, "x" * 500, "é ü ß Ä Ö " * 8, "the of and to in is that it was for on are as", "\x00\x01\x02 \x03"]
    words = ["The", "of", "und", "la", "el", "word", "Wort", "mot", "a1", "...", "?", "!", "***", "one.", "two!", "é", "UP", "42", "#", "|"]
    for _ in range(60):
        out.append(" ".join(RNG.choice(words) for _ in range(RNG.randrange(1, 120))))
    return out


def buffers(rows):
    raw = [t.encode() for t in rows]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def words_of(text):
    return [w.translate(LOWER) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def votes_of(text):
    raw, words = text.encode(), words_of(text)
    plain = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return None
    n, space = len(words), set(b" \t\n\x0b\x0c\r")
    upper = sum(65 <= b <= 90 or b == 2 for b in raw)
    letters = upper + sum(97 <= b <= 122 or b >= 128 or b < 2 for b in raw)
    seen = max(1, sum(b not in space for b in raw))
    odd = sum(chr(b) in "#$%&*<>@\\^_`{|}~=" for b in raw)
    bare = sum(len(w.encode()) == 1 and not (w[0].isascii() and w[0].isalnum()) and ord(w[0]) > 3 for w in plain)
    stops = max(1, sum(chr(b) in ".?" for b in raw))

    def again(size, near):
        grams = [tuple(words[i : i + size]) if i + size <= n else None for i in range(n)]
        return sum(g is not None and any(i >= j and grams[i - j] == g for j in range(1, near + 1)) for i, g in enumerate(grams)) / n

    vote = lambda x, bad, good: quality.BAD if x > bad else quality.GOOD if x < good else quality.NONE
    out = [
        vote(odd / seen, 0.06, 0.01), vote(upper / max(letters, 1), 0.4, 0.12), vote(sum(w.endswith("!") for w in words) / n, 0.15, 0.01), vote(bare / n, 0.15, 0.02),
        vote(-sum(w in quality.COMMON for w in words) / n, -0.06, -0.14), vote(1 - letters / seen, 0.18, 0.08), vote(n / stops, 60.0, 30.0),
        vote(again(1, 1), 0.15, 0.04), vote(again(2, 6), 0.15, 0.03), vote(again(3, 8), 0.15, 0.01), vote((n - len(set(words))) / n, 0.85, 0.75),
    ]
    return [quality.GOOD if n < quality.SHORT and i in (1, 4, 5) else v for i, v in enumerate(out)]


def test_labellers():
    rows = texts()
    got = quality.Features().votes(*buffers(rows))
    for code, text in zip(got.tolist(), rows, strict=True):
        want = votes_of(text)
        assert (code < 0) == (want is None), text
        if want is not None:
            assert [code // 3 ** (quality.N_VOTERS - 1 - i) % 3 for i in range(quality.N_VOTERS)] == want, text[:60]
    assert len(set(got.tolist())) > 15


def hash_of(tokenizer, word):
    raw = np.frombuffer(word, np.uint8)
    return int(tokenizer.words(raw, np.array([0, len(raw)])).hashes[0]) & (quality.BUCKETS - 1)


def test_hashed_features():
    rows, f = [t for t in texts() if t], quality.Features()
    tokenizer, classes = Tokenizer(SPACE_SEPARATORS), quality._classes()
    for text, (k, v) in zip(rows, f.hashed(*buffers(rows)), strict=True):
        mine: dict[int, float] = {}
        shape = bytes(int(classes[b]) for b in text.encode())
        shape = b"".join(bytes([b]) for i, b in enumerate(shape) if not i or b != shape[i - 1] or b == 32)
        runs = [w for w in re.split(rb"[\x20\x09-\x0D]+", shape) if w]
        for own, base, weight in (([hash_of(tokenizer, w) for w in runs], 0, 3.0), ([hash_of(tokenizer, w.encode()) for w in words_of(text)], quality.BUCKETS, 1.0)):
            for h in own:
                mine[base + h] = mine.get(base + h, 0.0) + weight / math.sqrt(len(own))
        norm = math.sqrt(sum(x * x for x in mine.values()))
        mine = {key: x / norm for key, x in mine.items()} if votes_of(text) else mine
        for i, vote in enumerate(reversed(votes_of(text) or [])):
            mine[2 * quality.BUCKETS + 3 * i + vote] = 0.3
        got = dict(zip(k.tolist(), v.tolist(), strict=True))
        assert got.keys() == mine.keys() and all(abs(got[x] - mine[x]) < 1e-6 for x in mine), text[:60]


def test_fit_and_scores(spark):
    """The fit by plain loops over rows and features; scores of the digest from the trained weights."""
    rows = [(np.array(sorted(RNG.sample(range(40), 5))), np.array([RNG.uniform(0.1, 1.0) for _ in range(5)])) for _ in range(30)]
    labels = np.array([float(0 in k or 3 in k) for k, _ in rows])
    w, b = quality.fit(rows, labels, steps=25)
    mine, bias, gw, gb = [0.0] * 40, 0.0, [1e-8] * 40, 1e-8
    for _ in range(25):
        errors = [(1 / (1 + math.exp(-(sum(mine[i] * x for i, x in zip(k, v, strict=True)) + bias))) - y) / len(rows) for (k, v), y in zip(rows, labels, strict=True)]
        g = [1e-6 * m for m in mine]
        for (k, v), e in zip(rows, errors, strict=True):
            for i, x in zip(k, v, strict=True):
                g[i] += e * x
        gw, gb = [a + x * x for a, x in zip(gw, g, strict=True)], gb + sum(errors) ** 2
        mine, bias = [m - 0.5 * x / math.sqrt(a) for m, x, a in zip(mine, g, gw, strict=True)], bias - 0.5 * sum(errors) / math.sqrt(gb)
    assert np.abs(w[:40] - mine).max() < 1e-9 and abs(b - bias) < 1e-9
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts(), None])] + [(None, "the same"), (3, "the same")], "doc_id long, text string")
    model = quality.train(docs)
    f = quality.Features()
    got = sorted(((r.doc_id, r.score, r.keep) for r in quality.digest(docs).collect()), key=repr)
    want = []
    for i, t in [tuple(r) for r in docs.collect()]:
        score = 0.0
        if words_of(t or ""):
            k, v = next(f.hashed(*buffers([t])))
            score = 1 / (1 + math.exp(-(float((model.weights[k] * v).sum()) + model.bias)))
        want.append((i, round(score, 6), round(score, 6) >= quality.KEEP))
    want.sort(key=repr)
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-6 and a[2] == b[2] for a, b in zip(got, want, strict=True))
    assert {g[2] for g in got} == {True, False}
