"""The ten operators against brute force, exact round trips or held-out labels, with their corner cases."""

import collections
import hashlib
import html
import itertools
import math
import random
import re

import numpy as np
import pytest
import regex

from tilewright.llm import avi, bpe, chat, licenses, near, packing, pages, pii, quality, queries, spots

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, _key string, k string, sigs string, code string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    """Real rows, and nulls, empty texts, ties, repeated rows, a long text, and further columns with clashing names."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(80)]
    for i in range(12):
        own = list(base)
        for _ in range(i // 3):
            own[rng.randrange(80)] = word()
        rows.append((10_000 + i, " ".join(own)))
    rows += [(-1, None), (-2, ""), (-3, "a b c"), (-4, "A  b\tc"), (-5, " \n "), (-6, "a b c d"), (-7, "🤣 é x@y.co +1 (243) 555-5526"), (-7, "🤣 é x@y.co +1 (243) 555-5526")]
    rows += [(20_000, " ".join(word() for _ in range(6000))), (20_001, "x" * 30_000)]
    return spark.createDataFrame([(i, t, "en", "a", "b", "c", "d") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 100_000])
def test_avi_round_trip(n):
    raw = random.Random(n).randbytes(n)
    payload = avi.payload_of(raw)
    media = avi.write(payload)
    fps, where = avi.frames(media)
    got = avi.levels(media, where)
    assert fps == avi.FPS and len(payload) % 576 == 0 and payload and b"".join(x.tobytes() for x in got) == payload
    at, size = where[0]
    head = avi._Head(media[at : at + size])
    scan = media[at + head.scan_at : at + size - 2].replace(b"\xff\x00", b"\xff")
    assert (avi._levels_bitwise(head, scan) == got[0]).all()  # any decoder's way gives the same
    # Without its index the frames are found in the movi list.
    cut = media[: media.rindex(b"idx1")]
    assert avi.frames(cut)[1] == where


def test_avi_shots(spark):
    rng = np.random.default_rng(1)
    parts = [rng.integers(lo, lo + 40, (30, 576), dtype=np.uint8) for lo in (0, 120, 200)]
    media = avi.write(np.concatenate(parts).tobytes())
    assert [c[3] for c in avi.clips_of(media)] == [0, 30, 60]
    df = spark.createDataFrame([(1, media), (2, None), (3, b"RIFFxxxx")], "id long, media binary")
    out = avi.detect_clips(df, "id", "media").collect()
    assert [(r.clip, r.start_s, r.end_s) for r in out if r.id == 1] == [(0, 0.0, 1.2), (1, 1.2, 2.4), (2, 2.4, 3.6)]
    assert all(r.error and r.clip is None for r in out if r.id > 1)


def test_avi_digest(docs, empty):
    out = avi.digest(docs).collect()
    assert len(out) == docs.count() and avi.digest(empty).count() == 0
    text = dict(pairs(docs))
    for r in out:
        payload = avi.payload_of(text[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest())


# 2


def test_pages(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r for r in pages.extract(table).collect()}
    for r in table.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1|div)[^>]*>", article)]
        assert out[r.page_id].text == "\n\n".join(x for x in blocks if x)
        assert out[r.page_id].n_chars == len(out[r.page_id].text)


def test_pages_differencing(spark):
    body = "<html><body><div>Welcome to the site</div><div class='menu'>m</div><p>Only on {0} &amp;&nbsp;here<br>now</p><div id=comments><p>c</p></div><div>Bye</div>"
    rows = [(i, f"http://h.com/a/{i}?q=1", body.format(f"page {i}"), "x") for i in range(5)]
    rows += [(9, None, None, "x"), (10, "http://z.org/", "<p>alone", "x"), (11, "rel", "", "x"), (4, "http://h.com/a/4?q=1", body.format("page 4"), "x"), (None, "http://m.com/", "<article><header><h1>T</h1><p>by</p></header>A<aside>s</aside><ul><li>c<li>d</ul></article><p>o", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = pages.extract(df).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    assert all(got[i] == f"Only on page {i} & here now" for i in range(5))
    assert got[9] == "" and got[10] == "alone" and got[11] == "" and got[None] == "T\n\nA\n\nc\n\nd"
    assert pages.extract(df.limit(0)).count() == 0


def test_longest_common_lines():
    rng = random.Random(2)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(2))
        assert len(pages.shared(a, b)) == length(a, b)


def test_url_neighbours(spark):
    rng = random.Random(4)
    paths = sorted({"/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    df = spark.createDataFrame([("h", p, p) for p in paths] + [("z", "/", "z")], "host string, path string, rep string")
    got = {(r.host, r.path): r.near for r in pages.neighbours(df).collect()}
    common = lambda a, b: len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(a, b, strict=False))))
    assert got["z", "/"] is None
    for p in paths:
        assert common(p, got["h", p]) == max(common(p, q) for q in paths if q != p)


# 3


def test_licenses(spark, docs, empty):
    more = [(-20, "Under the MIT license, under the mit license CC BY-NC"), (-21, "é under  the mit-license apache License VERSION 2"), (-22, licenses.TEMPLATES[0][1].replace("obtaining", "getting")), (-23, licenses.TEMPLATES[1][1])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = licenses.scan(df).collect()
    assert len(out) == df.count() and licenses.scan(empty).count() == 0
    out = {r.doc_id: r for r in out}
    for i, text in pairs(df):
        words, at, labels = licenses.words_of(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    assert out[-22].labels == "mit" and out[-22].base_labels == "" and 0.7 <= out[-22].score < 1 and out[-23].labels == "isc"


# 4

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d))))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def test_pii_base(spark, docs, empty):
    more = [(-30, "é🤣 a@b.c%d@e.f ..@x.y.z 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.03.255 4111 1111 1111 1111-4111111111111111 +1 (243) 555-5526 +12345678901234567 +4 9.9-99999999-"), (-31, "4111111111111111"), (-32, "a@b" + ".c" * 4000 + " " + "1 2-" * 3000 + "9 +" + "1" * 3000)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = pii.digest(df).collect()
    assert len(out) == df.count() and pii.digest(empty).count() == 0
    out = {r.doc_id: r for r in out}
    for i, text in pairs(df):
        found = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(k, m[0]))
        assert out[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found)), i
        assert out[i].n_email == sum(f[2] == "email" for f in found)


def test_pii_terms(spark):
    rows = [(i, f"Dr Zyxwab of Quorville wrote to anna@x{i % 3}.com about item {i}\nother line {i}") for i in range(12)] + [(100 + i, f"the item about other of wrote to line {i} number") for i in range(60)] + [(200, "Zyxwab alone here"), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.entity, r.term) for r in pii.disclosing(df.where("length(text) > 0"), share=0.5).collect()}
    lines = {x for _, t in rows if t for x in t.split("\n")}
    n_e, n_t, n_et = collections.Counter(), collections.Counter(), collections.Counter()
    for line in lines:
        n_t.update(set(re.findall(r"[^\W_]{2,}", line.lower())))
        for e in re.findall(r"[\w.]+@[\w.]+", line):
            n_e["0:" + e] += 1
            n_et.update(("0:" + e, t) for t in set(re.findall(r"[^\W_]{2,}", line.replace(e, " ").lower())))
    n = len(lines)
    assert got == {(e, t) for (e, t), c in n_et.items() if c >= 3 and math.log(n * c / (n_e[e] * n_t[t])) >= 0.5 * math.log(n / n_e[e])} and got
    clean = {r.doc_id: r.text for r in pii.sanitise(df, share=0.5).collect()}
    assert clean[0] == "[TERM] [TERM] of [TERM] wrote to [EMAIL] about item 0\nother line 0"
    assert clean[200] == "Zyxwab alone here" and clean[201] is None and clean[202] == ""


# 5


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(150):
        n, k = rng.randint(1, 9), rng.randint(1, 5)
        x, c = sorted(rng.sample(range(60), n)), [rng.randint(1, 9) for _ in range(n)]
        cost = lambda bounds: sum((min(b for b in bounds if b >= v) - v) * m for v, m in zip(x, c, strict=True))  # noqa: B023, E731
        got = packing.boundaries(np.array(x), np.array(c), k)
        assert len(got) <= k and cost(got) == min(cost([*s, x[-1]]) for r in range(min(k, n)) for s in itertools.combinations(x[:-1], r))


def test_packing(docs, empty, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 7)
    out = packing.pack(docs, budget=2048).collect()
    assert len(out) == docs.count() and packing.pack(empty).count() == 0
    batches = collections.defaultdict(list)
    for r in out:
        batches[r.bucket, r.batch].append(r)
    last = {b: max(k for x, k in batches if x == b) for b, _ in batches}
    for (b, k), rows in batches.items():
        per = max(1, 2048 // max(1, rows[0].padded))
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and len(rows) <= per and (len(rows) == per or k == last[b])
        assert all(r.n_tokens <= r.padded and r.padding == r.padded - r.n_tokens for r in rows)


# 6


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.9, 0.8, 0.75, 0.6, 0.85])
    votes = np.where(rng.random((20_000, 5)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = quality.NONE
    codes = sum(votes[:, i] * 3 ** (4 - i) for i in range(5))
    u, n = np.unique(codes, return_counts=True)
    posterior, table, prior = quality.em(u, n, 5)
    assert abs(prior - 0.7) < 0.03
    for v in range(5):
        assert abs(table[v, 1, 1] / (table[v, 1, 0] + table[v, 1, 1]) - accuracy[v]) < 0.03
    assert np.mean((np.array([posterior[c] for c in codes]) >= 0.5) == truth) > 0.93


def test_quality_on_labels(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.digest(table).join(labels, "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15
    out = by_id(quality.digest(docs))
    assert not out[-1].keep and not out[-2].keep and quality.digest(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


# 7


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: grams(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near(docs, empty):
    out = near.link(docs).collect()
    assert len(out) == docs.count() and near.link(empty).count() == 0
    want = brute_components(pairs(docs))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_near_chain(spark, monkeypatch):
    """A chain of texts that link only with their neighbours, in small chunks and salted cells."""
    monkeypatch.setattr(near, "CHUNK", 4)
    monkeypatch.setattr(near, "HOT_LEVEL", 1)
    rng = random.Random(8)
    stream = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(stream[i * 6 : i * 6 + 90])) for i in range(50)] + [(100, " ".join(stream[:90])), (101, " ".join(stream[200:240]))]
    out = near.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)


def test_rtree_misses_nothing():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 6, 64)
    points = np.stack([np.maximum(0, base + rng.integers(-2, 3, 64)) for _ in range(300)] + [rng.integers(0, 6, 64) for _ in range(200)])
    sizes = points.sum(axis=1)
    tree = near.RTree(points, sizes)
    for i in range(0, 500, 7):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(axis=1) >= near.needed(sizes, sizes[i]))
        assert sorted(tree.search(points[i], sizes[i])) == want.tolist()


# 8


def test_bpe_equals_library(docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    theirs, own = Tokenizer.from_file(path), bpe.load(path)
    texts = [t for _, t in pairs(docs)] + ["hello world's don't 123 <|endoftext|> ΑΣ ΣΣ. İstanbul \u2028x\u200by éé 日本語 🤣🤣 \x00\x01", "a\x1cb c\x1f\x1fd\x85e\xa0f", "aaaa ahahahahaha lolololol ....... =-=-=-", "DŽ ß ẞ ﬁ Ⅳ ½ ͅ ́ <|startoftext|>x", "'S 'LL we'RE"]
    for text, (ids, tokens, n) in zip(texts, own.encode_many(texts), strict=True):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert [int(x) for x in ids.split()] == want and n == len(want)
        assert tokens == own.decode(want) == theirs.decode(want, skip_special_tokens=False)
    out = by_id(bpe.digest(docs, path))
    assert len(out) == len(dict(pairs(docs))) and bpe.digest(empty, path).count() == 0
    assert out[-1].n_tokens == 0 and out[-1].ids_sha256 == sha("")
    both = bpe.decode(bpe.encode(docs, path), path)
    assert {r.doc_id: sha(r.text) for r in both.collect()} == {i: r.decoded_sha256 for i, r in out.items()}


# 9


def spot_set(text):
    words, every = regex.findall(r"[\p{L}\p{N}]+", text.lower()), {*spots.ANCHORS, *spots.SKIPPED}
    chains = {(w, *c) for i, w in enumerate(words) if w in spots.ANCHORS and len(c := [x for x in words[i + 1 :] if x not in every][:2]) == 2}
    return chains or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_spots(docs, empty):
    rows = sorted(dict(pairs(docs)).items())
    out = spots.digest(docs).collect()
    assert len(out) == docs.count() and spots.digest(empty).count() == 0
    out = {r.doc_id: r for r in out}
    for i, (k, text) in enumerate(rows):
        after, cut = rows[(i + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = out[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert abs(r.near_edited - jaccard(spot_set(text), spot_set(edited))) < 1e-9 and abs(r.near_next - jaccard(spot_set(text), spot_set(after))) < 1e-9


def test_spot_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(60)}" if j % 3 else rng.choice(["is", "was", "und"]) for j in range(60)]
        rows.append((2 * i, " ".join(words)))
        words[rng.randrange(60)] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {r.doc_id: r.fingerprint_id for r in spots.members(df).collect()}
    got = {(r.fingerprint_id, r.near_id) for r in spots.near_pairs(df).collect()}
    sets = {i: spot_set(t) for i, t in rows}
    want = {tuple(sorted((ids[a], ids[b]))) for a, b in itertools.combinations(sets, 2) if ids[a] != ids[b] and jaccard(sets[a], sets[b]) >= 0.8}
    assert got == want and want


# 10


def test_chat(spark):
    trap = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", trap), (1, 1, "assistant", trap), (1, 2, None, None), (2, 0, "assistant", ""), (2, 1, "assistant", "é🤣\n"), (3, 1, "us:er%3A", "x"), (3, 1, "us:er%3A", "x"), (None, None, "user", "n")]
    out = {r.conv_id: r for r in chat.digest(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert out.keys() == {1, 2, 3, None}
    groups = collections.defaultdict(list)
    for c, _, role, text in rows:
        groups[c].append((role or "", text or ""))
    for c, turns in groups.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said))


@pytest.mark.parametrize("text", ["", "\\", "###", "</turn>", "\\</turn>", "a</turn", "</turn>\n### user: x</turn>\n", "<", "\\\\###%3A: é"])
def test_template_is_reversible(text):
    out = chat.format_turn("a:b%3A", text) + chat.format_turn("assistant", text)
    assert [(r, t) for r, t, _, _ in chat.read_turns(out)] == [("a:b%3A", text), ("assistant", text)]


def test_reply_trees(spark):
    rows = [(1, 1, None, 1.0), (1, 2, 1, 2.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 4, None), (1, 6, 99, 3.0), (2, 1, 2, 1.0), (2, 2, 1, 1.0), (3, 1, None, 1.0)] + [(4, i, i - 1 if i else None, 1.0) for i in range(20)]
    got = collections.defaultdict(list)
    for r in chat.paths(spark.createDataFrame(rows, "conv long, node long, parent long, score double"), best=2).orderBy("conv", "rank", "depth").collect():
        got[r.conv, r.rank, r.branch_score].append(r.node)
    assert got == {(1, 1, 12.0): [1, 2, 4, 5], (1, 2, 6.0): [1, 3], (3, 1, 1.0): [1], (4, 1, 20.0): list(range(20))}


# The pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline

    now = docs.withColumn("source", docs["lang"]).withColumn("n_chars", docs["doc_id"].cast("int"))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = spark.createDataFrame(stage(spark, now, SF).collect(), now.schema)
        after = {r.doc_id: r.text for r in now.collect()}
        assert now.columns == columns and after.keys() <= before.keys(), name
        if name == "n-gram Jaccard join":
            want = brute_components(list(before.items()))
            assert after.keys() == {i for i, (_, c) in want.items() if c == i}
        if name == "personal data":
            assert after.keys() == before.keys()
            assert not any(re.search(PATTERNS["email"], t or "") for t in after.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.count() == now.count()


