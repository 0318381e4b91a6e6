"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over
the corpus histogram of vote patterns estimates how often each labeller says what of good
and of bad texts, and so the posterior of each pattern. On a sample of texts the posteriors
are the labels of a linear scorer over hashed words and hashed word shapes, which then
judges every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.wordhash import SPACE_SEPARATORS, Tokenizer, chunks

#: About so many texts train the scorer (all, if there are fewer); the vote histogram covers all texts.
SAMPLE = 8192
BUCKETS = 1 << 16
N_VOTERS = 11
WIDTH = 2 * BUCKETS + 3 * N_VOTERS
#: Texts whose score is lower are rejected.
KEEP = 0.5
GOOD, BAD, NONE = 1, 0, 2
#: Shares of letters and common words say nothing against texts of fewer words.
SHORT = 12

# Frequent words of English, French, German and Spanish.
COMMON = frozenset(
    "the of and to in is that it was for on are as with by at be this from an or have had not "
    "de la le les et des en un une du que est pour qui dans sur par au avec pas ce "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "el los las y del se por con para su al lo más como pero".split()
)
_LETTER, _UPPER, _DIGIT = 1, 2, 3


def _classes() -> np.ndarray:
    c = np.arange(256, dtype=np.uint8)
    c[97:123] = c[128:256] = _LETTER
    c[65:91] = _UPPER
    c[48:58] = _DIGIT
    c[SPACE_SEPARATORS] = 32
    return c


class Features:
    """Votes and hashed features of texts, from whole buffers."""

    def __init__(self) -> None:
        self.classes, self.words = _classes(), Tokenizer(SPACE_SEPARATORS)
        self.shapes = Tokenizer(SPACE_SEPARATORS)
        joined = " ".join(sorted(COMMON)).encode()
        self.common = np.sort(self.words.words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)])).hashes)

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text the votes as one number in base 3, -1 for texts without words."""
        c = self.classes[data]

        def per_text(mask: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

        w = self.words.words(data, offsets)
        n_words = np.maximum(np.diff(w.first), 1)
        letters, upper = per_text(c <= _UPPER), per_text(c == _UPPER)
        seen = np.maximum(per_text(c != 32), 1)
        known = np.zeros(len(data) + 1, bool)
        known[w.start[np.isin(w.hashes, self.common)]] = True
        stop = (data == ord(".")) | (data == ord("?"))
        odd_char = np.zeros(256, bool)
        odd_char[[ord(x) for x in "#$%&*<>@\\^_`{|}~="]] = True
        first = c[w.start] if len(w.start) else np.zeros(0, np.uint8)
        last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
        bare = np.zeros(len(data) + 1, bool)
        bare[w.start[(w.end - w.start == 1) & (first > _DIGIT)]] = True
        loud = np.zeros(len(data) + 1, bool)
        loud[w.start[last == ord("!")]] = True
        rate = lambda mask: per_text(mask[:-1]) / n_words

        def repeated(size: int, near: int) -> np.ndarray:
            """Share of a text's words that begin a run of `size` words which also began up to `near` words before."""
            h, ok = w.grams(size)
            again = np.zeros(len(data) + 1, bool)
            for j in range(1, near + 1):
                at = np.flatnonzero((h[j:] == h[:-j]) & ok[j:]) + j
                again[w.start[at[at - j >= w.first[np.searchsorted(w.first, at, "right") - 1]]]] = True
            return rate(again)

        # How often a text's words are not the first of their kind in it.
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
        order = np.lexsort((w.hashes, text_of))
        old = np.zeros(len(w.hashes), bool)
        old[1:] = (w.hashes[order][1:] == w.hashes[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
        old_share = np.bincount(text_of[order], old, len(offsets) - 1) / n_words

        def vote(x: np.ndarray, bad_over: float, good_under: float) -> np.ndarray:
            return np.where(x > bad_over, BAD, np.where(x < good_under, GOOD, NONE))

        all_votes = [
            vote(per_text(odd_char[data]) / seen, 0.06, 0.01),
            vote(upper / np.maximum(letters, 1), 0.4, 0.12),
            vote(rate(loud), 0.15, 0.01),
            vote(rate(bare), 0.15, 0.02),
            vote(-rate(known), -0.06, -0.14),
            vote(1 - letters / seen, 0.18, 0.08),
            vote(n_words / np.maximum(per_text(stop), 1), 60.0, 30.0),
            vote(repeated(1, 1), 0.15, 0.04),
            vote(repeated(2, 6), 0.15, 0.03),
            vote(repeated(3, 8), 0.15, 0.01),
            vote(old_share, 0.85, 0.75),
        ]
        all_votes = [np.where(n_words < SHORT, GOOD, v) if i in (1, 4, 5) else v for i, v in enumerate(all_votes)]
        code = np.zeros(len(offsets) - 1, np.int64)
        for v in all_votes:
            code = code * 3 + v
        return np.where(np.diff(w.first) > 0, code, -1)

    N_VOTERS = N_VOTERS

    def hashed(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the buckets of its words, word shapes and votes, and their values; shape runs count once ("a***" is "a*")."""
        c = self.classes[data]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != c[:-1]) | (c[1:] == 32)
        keep[offsets[:-1][offsets[:-1] < len(c)]] = True
        w = self.words.words(data, offsets)
        s = self.shapes.words(c[keep], np.concatenate([[0], np.cumsum(keep)])[offsets])
        votes = self.votes(data, offsets)
        for i in range(len(offsets) - 1):
            parts = []
            for j, x in enumerate((s, w)):
                h = (x.hashes[x.first[i] : x.first[i + 1]] & np.uint64(BUCKETS - 1)).astype(np.int64) + j * BUCKETS
                u, n = np.unique(h, return_counts=True)
                parts.append((u, n / max(1, len(h)) ** 0.5 * (3.0 if j == 0 else 1.0)))
            k, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            norm = float(np.sqrt((v * v).sum()))
            if votes[i] >= 0:
                own = [2 * BUCKETS + 3 * j + int(votes[i]) // 3**j % 3 for j in range(self.N_VOTERS)]
                k, v = np.concatenate([k, own]), np.concatenate([v / norm, np.full(len(own), 0.3)])
            yield k, v


def em(codes: np.ndarray, counts: np.ndarray, n_voters: int, rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """(posterior of good by pattern, table[voter, truth, vote], share of good) from a histogram of vote patterns.

    Starts at the share of good among a pattern's votes, so that good and bad keep their meaning. Patterns without
    votes get the share of good."""
    digits = np.stack([codes // 3**i % 3 for i in range(n_voters - 1, -1, -1)], axis=1)
    good, bad = (digits == GOOD).sum(axis=1), (digits == BAD).sum(axis=1)
    p = (good + 0.5) / (good + bad + 1.0)
    table, prior = np.full((n_voters, 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = float(np.clip(weight[1].sum() / max(counts.sum(), 1), 0.02, 0.98))
        for v in range(n_voters):
            for vote in range(3):
                table[v, :, vote] = weight[:, digits[:, v] == vote].sum(axis=1) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(np.array([1 - prior, prior]))[:, None] + sum(np.log(table[v][:, digits[:, v]]) for v in range(n_voters))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return dict(zip(codes.tolist(), p.tolist(), strict=True)), table, prior


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 150, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft labels, by full-batch Adagrad."""
    w, b = np.zeros(WIDTH), 0.0
    if not rows:
        return w, b
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    k, v = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    gw, gb = np.full(WIDTH, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, w[k] * v, len(rows)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / len(rows)
        g, h = np.bincount(k, e[row] * v, WIDTH) + decay * w, float(e.sum())
        gw += g * g
        gb += h * h
        w -= 0.5 * g / np.sqrt(gw)
        b -= 0.5 * h / gb**0.5
    return w, b


class Model:
    def __init__(self, posterior: dict[int, float], table: np.ndarray, prior: float, weights: np.ndarray, bias: float) -> None:
        self.posterior, self.table, self.prior, self.weights, self.bias = posterior, table, prior, weights.astype(np.float32), bias


def train(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits labellers on all texts' votes, and the scorer on about `sample` texts, those of the least text digests.

    Null, empty and blank texts don't train. Copies of a text are in the sample all or none."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, total = Features(), np.zeros(3**Features.N_VOTERS, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                v = f.votes(data, offsets)
                total += np.bincount(v[v >= 0], minlength=len(total))
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(total[codes], pa.int64())], names=["code", "n"])

    got = df.select(text_col).mapInArrow(votes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    codes, counts = np.array([r.code for r in got], np.int64), np.array([r.n for r in got], np.int64)
    if not len(codes):
        return Model({}, np.full((Features.N_VOTERS, 2, 3), 1 / 3), 1.0, np.zeros(WIDTH), 10.0)
    posterior, table, prior = em(codes, counts, Features.N_VOTERS)
    share = min(1.0, sample / counts.sum())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                rows = [(int(v), k.astype("<u4").tobytes(), x.astype("<f4").tobytes()) for v, (k, x) in zip(f.votes(data, offsets), f.hashed(data, offsets), strict=True) if v >= 0]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["code", "k", "v"])

    # One of each text: a large group of copies must not fill the sample.
    few = df.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < int(share * (1 << 30))).select(text_col).distinct()
    rows = sorted(few.mapInArrow(features, "code long, k binary, v binary").collect(), key=lambda r: (r.code, r.k, r.v))
    sparse = [(np.frombuffer(r.k, "<u4").astype(np.int64), np.frombuffer(r.v, "<f4").astype(np.float64)) for r in rows]
    weights, bias = fit(sparse, np.array([posterior[r.code] for r in rows]))
    return Model(posterior, table, prior, weights, bias)


def scorer(model: Model):
    """A column function text -> score from 0 to 1; null, empty and blank texts have 0."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        f, out = Features(), np.zeros(len(texts))
        for at, data, offsets in chunks(texts):
            for i, (k, v) in enumerate(f.hashed(data, offsets)):
                if len(k):
                    z = float((model.weights[k] * v).sum() + model.bias)
                    out[at + i] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return pa.array(np.round(out, 6))

    return score


def keep_good(df: DataFrame, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of df whose text is not rejected, with all their columns. Equal texts share their fate; null, empty and
    blank texts are rejected."""
    return df.where(scorer(train(df, text_col))(F.col(text_col)) >= keep)


def digest(df: DataFrame) -> DataFrame:
    """(doc_id, score, keep): one row for each row of df.

    Null, empty and blank texts have score 0; equal texts have equal scores, repeated rows and null ids rows of their
    own. A score of just KEEP is kept. A table without words keeps none; an empty one gives none. Other columns are not
    read."""
    rows = df.select("doc_id", scorer(train(df))(F.col("text")).alias("score"))
    return rows.select("doc_id", "score", (F.col("score") >= KEEP).alias("keep"))
