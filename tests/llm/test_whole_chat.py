"""The registered query against brute force, long chains, and trees with many branches."""

import collections
import hashlib
import random

from tilewright.llm import chat, queries

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_registered_query(spark):
    trap = "\\### Assistant: </turn> ok"
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    turns += [(-7, 0, "user", trap), (-7, 1, "assistant", trap)]
    want = collections.defaultdict(list)
    for c, _, role, text in sorted(turns, key=lambda r: r[:2]):
        want[c].append((role, text or ""))
    out = queries.op10_chat(spark, SF).collect()
    assert sorted(r.conv_id for r in out) == sorted(want)
    for r in out:
        said = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        chars = sum(len(chat.format_turn(role, t)) for role, t in want[r.conv_id])
        assert r[1:] == (len(want[r.conv_id]), sha("".join(f"{role}\n{t}\n" for role, t in want[r.conv_id])), len(said), sha(said), chars)


def test_ids_of_other_types_and_a_long_chain(spark):
    rows = [("a", i, "user" if i % 2 else "assistant", f"t{i}") for i in range(300)] + [("b", 0, None, None), (None, 1, "user", "n")]
    out = {r.conv_id: r for r in chat.digest(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert out.keys() == {"a", "b", None} and out["a"].n_turns == 300 and out["b"].n_turns == 1
    assert out["a"].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:300]))


def test_branches_of_random_trees(spark):
    rng = random.Random(9)
    rows, parent = [], {}
    for c in range(6):
        for n in range(40):
            parent[c, n] = rng.randrange(max(0, n - 6), n) if n and rng.random() < 0.95 else None
            rows.append((c, n, parent[c, n], float(rng.randint(0, 9)) if rng.random() < 0.9 else None, "assistant" if n % 2 else "user", f"text {c}/{n}", "x", 1))
    df = spark.createDataFrame(rows, "conv long, node long, parent long, score double, role string, text string, branch string, c int")
    score = {(r[0], r[1]): r[3] or 0.0 for r in rows}
    want = {}
    for c in range(6):
        inner = {parent[c, n] for n in range(40)}
        paths = []
        for leaf in set(range(40)) - inner:
            path = [leaf]
            while parent[c, path[-1]] is not None:
                path.append(parent[c, path[-1]])
            paths.append((sum(score[c, n] for n in path), leaf, path[::-1]))
        for rank, (total, _, path) in enumerate(sorted(paths, reverse=True)[:3], 1):
            want[c, rank] = (total, path)
    chosen = chat.paths(df, best=3)
    got = collections.defaultdict(list)
    for r in chosen.orderBy("conv", "rank", "depth").collect():
        got[r.conv, r.rank, r.branch_score].append(r.node)
    assert {(c, k): (s, p) for (c, k, s), p in got.items()} == want
    said = df.select("conv", "node", "role", "text")
    texts = {(r.conv, int(r.branch)): r.formatted for r in chat.formatted(chosen.join(said, ["conv", "node"])).collect()}
    assert texts == {(c, p[-1]): "".join(chat.format_turn("assistant" if n % 2 else "user", f"text {c}/{n}") for n in p) for (c, _), (_, p) in want.items()}
