"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch go into a trie of symbols. A depth-first walk carries,
for each prefix, the last token of its encoding: the only token t that ends the prefix
for which (last token of what precedes t, t) is a pair that BPE leaves apart. A shared
prefix is thus encoded once; a word's tokens are read back along the chain of last tokens."""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words whose encodings a task keeps; beyond it the trie and memo start anew (results don't change).
MEMO_WORDS = 600_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in keep else chr(256 + extra))
        extra += b not in keep
    return out


class TrieBPE:
    """A tokenizer file of the `tokenizers` library whose model is BPE over byte-level symbols with a word-end mark.

    encode() equals that library's encode(text, add_special_tokens=False); decode() its decode(ids, skip_special_tokens=False)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.text_of_decimal = {str(i): t for i, t in self.text_of.items()}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.symbols = byte_symbols()
        #: Per token: when it is made (0 for a symbol), from what, and how many symbols it has. Per pair: when it merges.
        self.made: dict[str, int] = {}
        self.split: dict[str, tuple[str, str]] = {}
        self.size: dict[str, int] = {}
        for t in self.ids:
            if len(self._symbols_of(t)) == 1:
                self.made[t], self.size[t] = 0, 1
        self.merge_at: dict[tuple[str, str], int] = {}
        for i, (x, y) in enumerate(merges, 1):
            self.merge_at.setdefault((x, y), i)
            if x + y not in self.made:
                self.made[x + y], self.split[x + y] = i, (x, y)
                self.size[x + y] = self.size[x] + self.size[y]
        #: Tokens within a word and at its end, by their symbols without the end mark; only those that BPE itself arrives at.
        self.inner: dict[str, str] = {}
        self.final: dict[str, str] = {}
        #: By a token's last three characters: the sizes that such tokens have, largest first; then two and one are tried.
        inner_sizes: dict[str, set[int]] = {}
        final_sizes: dict[str, set[int]] = {}
        for t in self.made:
            if t in self.split and not self._apart_parts(t):
                continue
            ends = bool(self.end) and t.endswith(self.end) and len(t) > len(self.end)
            body = t[: -len(self.end)] if ends else t
            (self.final if ends else self.inner)[body] = t
            if len(body) > 2:
                (final_sizes if ends else inner_sizes).setdefault(body[-3:], set()).add(len(body))
        self.inner_sizes = {k: (*sorted(v, reverse=True), 2) for k, v in inner_sizes.items()}
        self.final_sizes = {k: (*sorted(v, reverse=True), 2) for k, v in final_sizes.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, tuple[str, int]] = {}

    def _symbols_of(self, token: str) -> tuple[str, ...]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return (*body[:-1], body[-1] + self.end)
        return tuple(token)

    def _apart_parts(self, token: str) -> bool:
        """Whether BPE on the token's symbols arrives at the token: its two parts don't merge otherwise before."""
        x, y = self.split[token]
        return self._apart(x, y, self.made[token])

    def _apart(self, a: str, b: str, before: int = 1 << 60) -> bool:
        """Whether no merge across the border of a and b comes before the time `before` or before a and b are whole.

        Goes back through the merges that made the two border tokens, the latest first, and looks
        at each stage whether the two pieces at the border merge before the later of them goes on."""
        made, split, merge_at = self.made, self.split, self.merge_at
        limit, left_last = before, False
        while True:
            at = merge_at.get((a, b))
            # At equal times the same merge applies from left to right: the left piece's own merge comes first.
            if at is not None and (at < limit or at == limit and not left_last and limit != before):
                return False
            if made[a] > made[b]:
                limit, left_last, a = made[a], True, split[a][1]
            elif b in split:
                limit, left_last, b = made[b], False, split[b][0]
            else:
                return True

    def _learn(self, words: Iterator[str]) -> None:
        """Insert the words into one trie and walk it depth first; a word's last symbol is its own, with the end mark."""
        root: dict = {}
        symbols = self.symbols
        for w in words:
            s = w if w.isascii() and w.isprintable() else "".join([symbols[b] for b in w.encode()])
            node = root
            for c in s[:-1]:
                child = node.get(c)
                if child is None:
                    child = node[c] = {}
                node = child
            node["$" + s[-1]] = w
        inner, final, inner_sizes, final_sizes, pairs, size_of, ids, memo = self.inner, self.final, self.inner_sizes, self.final_sizes, self.pairs, self.size, self.ids, self.memo
        short = (2,)
        last: list[str] = []
        # Of a prefix only as much is kept as a token may have.
        keep = 1 - max(size_of.values())
        todo: list[tuple[int, str, dict]] = [(0, "", root)]
        while todo:
            depth, prefix, node = todo.pop()
            if depth:
                # The last token of the prefix, of those that end it.
                del last[depth - 1 :]
                for size in inner_sizes.get(prefix[-3:], short) if depth > 1 else ():
                    if size > depth:
                        continue
                    t = inner.get(prefix[-size:])
                    if t is None:
                        continue
                    if size == depth:
                        break
                    key = (last[depth - size - 1], t)
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self._apart(*key)
                    if ok:
                        break
                else:
                    t = inner[prefix[-1]]
                last.append(t)
            n = depth + 1
            for c, child in node.items():
                if len(c) == 1:
                    todo.append((n, prefix[keep:] + c, child))
                    continue
                s = prefix + c[1]
                for size in final_sizes.get(s[-3:], short) if n > 1 else ():
                    if size > n:
                        continue
                    t = final.get(s[-size:])
                    if t is None:
                        continue
                    if size == n:
                        break
                    key = (last[n - size - 1], t)
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self._apart(*key)
                    if ok:
                        break
                else:
                    t = final[c[1]]
                out, at = [t], n - size_of[t]
                while at:
                    t = last[at - 1]
                    out.append(t)
                    at -= size_of[t]
                out.reverse()
                memo[child] = (" ".join([str(ids[t]) for t in out]), len(out))

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.at_special.finditer(text) if self.at_special else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case by single characters (no final sigma). White space only parts words, so it stays as it is."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    @staticmethod
    def split_chunks(text: str) -> list[str]:
        """At white space; str.split would also split at U+001C to U+001F, which are none in Unicode."""
        return regex.split(r"\s+", text) if regex.search("[\x1c-\x1f]", text) else text.split()

    def encode_many(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """Per text: its ids joined by spaces, the text decoded from them, their number."""
        return [(ids, self.decode_joined(ids), n) for ids, n in self.ids_of(texts)]

    def ids_of(self, texts: list[str]) -> list[tuple[str, int]]:
        """Per text: its ids joined by spaces, and their number."""
        if len(self.memo) > MEMO_WORDS:
            self.reset()
        if len(self.pairs) > 4 * MEMO_WORDS:
            self.pairs = {}
        memo = self.memo  # a white-space chunk that is one word has the same entry
        split = []
        for text in texts:
            own: list[str] = []
            for piece, special in self._pieces(text):
                if special:
                    own.append("\0 " + piece)  # no chunk has a space
                    memo["\0 " + piece] = (str(self.special[piece]), 1)
                elif piece:
                    own += self.split_chunks(self.normal(piece))
            split.append(own)
        new = [c for c in set().union(*split) if c not in memo]
        words = {c: self.pattern.findall(c) for c in new}
        missing = [w for w in set().union(*words.values()) if w not in memo]
        if missing:
            self._learn(iter(missing))
        for c, ws in words.items():
            got = [memo[w] for w in ws]
            if ws != [c]:
                memo[c] = got[0] if len(got) == 1 else (" ".join([g[0] for g in got]), sum([g[1] for g in got]))
        out = []
        for own in split:
            if own:
                ids, counts = zip(*map(memo.__getitem__, own), strict=True)
                out.append((" ".join(filter(None, ids) if 0 in counts else ids), sum(counts)))
            else:
                out.append(("", 0))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.ids_of([text])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.text_of[i] for i in ids])

    def decode_joined(self, ids: str) -> str:
        """decode() of decimal ids joined by spaces."""
        return " ".join(map(self.text_of_decimal.__getitem__, ids.split()))


@functools.lru_cache(2)
def load(path: str) -> TrieBPE:
    return TrieBPE(path)


@contextmanager
def _no_gc() -> Iterator[None]:
    """The memo's many tuples have no cycles: the collector only costs time over them. Workers serve other tasks after."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _encoded(df: DataFrame, vocabulary: str, id_col: str, text_col: str, outputs: dict[str, tuple[pa.DataType, str]], row) -> DataFrame:
    """id and `outputs` (Arrow and SQL types by name), which row(bpe, ids, number of ids) gives for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        with _no_gc():
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    got = [row(bpe, *x) for x in bpe.ids_of([t or "" for t in part.column(1).to_pylist()])]
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[i] for g in got], t) for i, (t, _) in enumerate(outputs.values()))], names=[id_col, *outputs])

    types = ", ".join(f"{n} {t}" for n, (_, t) in outputs.items())
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {types}")


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids string, n_tokens) of every row.

    vocabulary: a path that every executor can read, such as that of an installed package's data file.
    Null and empty texts have no tokens. Ids may be of any type and null; repeated rows stay; other columns are not read."""
    return _encoded(df, vocabulary, id_col, text_col, {"ids": (pa.string(), "string"), "n_tokens": (pa.int64(), "long")}, lambda bpe, ids, n: (ids, n))


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from the ids string of every row; null or no ids give the empty text, an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode_joined(s or "") for s in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")


def digest(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, one row for each row of df.

    Null and empty texts have no tokens; null ids and repeated rows get their own rows; other columns are not read."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    outputs = {"n_tokens": (pa.int64(), "long"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}
    return _encoded(df, vocabulary, "doc_id", "text", outputs, lambda bpe, ids, n: (n, sha(ids), sha(bpe.decode_joined(ids))))
