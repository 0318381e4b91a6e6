"""Fill-in-middle transformation, with its cuts found by a parallel automaton scan.

A finite automaton reads a text, ends a unit (a line) at some steps and remembers whether a
marker occurred. A chunk of text that doesn't know how the text before it ended emits what the
automaton does to it from every state: the state it ends in, and the units that end in it. These
functions compose associatively, so chunks are scanned at the same time and their composition
tells each chunk its entry state and the units before it; then only the chunks in which a cut
lies look for its place. Texts of one chunk go the same way inside one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import null_safe_key, scratch

#: Code points of a chunk; longer texts are dealt out in chunks.
CHUNK = 1 << 16
#: Steps that a block of a chunk takes; blocks are scanned side by side.
BLOCK = 16
#: So many rows of cuts are sent to every task; more are joined by exchange.
SENT = 100_000
#: Names of the parts of an output, and the shares (of 100) of documents cut and of cut ones that begin with the suffix.
MARKERS = ("<P>", "<S>", "<M>")
RATE, SPM, SEED = 100, 50, 7


class Automaton:
    """Ends a unit at each line feed and at the end of a text that doesn't end in one; notices the first marker.

    Characters that neither end a unit nor stand in a marker are class 0. A second one of them in a row changes
    nothing, so runs of them count as one step. The last class is a step that leaves every state as it is."""

    def __init__(self, markers: Sequence[str] = MARKERS) -> None:
        self.markers = tuple(markers)
        if not all(self.markers) or any("\n" in m or not m.isascii() for m in self.markers):
            raise ValueError("markers are one or more ASCII characters without line feed")
        letters = sorted({c for m in self.markers for c in m})
        self.class_of = np.zeros(129, np.uint8)
        self.class_of[ord("\n")] = 1
        self.class_of[[ord(c) for c in letters]] = np.arange(len(letters)) + 2
        begun = sorted({m[:i] for m in self.markers for i in range(len(m))})  # what may become a marker; "" comes first
        found = len(begun)
        self.size = 2 * (found + 1)  # whether a unit is open, and how much of a marker was read
        self.found = np.arange(self.size) % (found + 1) == found
        self.open = np.arange(self.size) > found
        self.idle = len(letters) + 2
        self.step = np.zeros((self.size, self.idle + 1), np.uint8)
        self.ends = np.zeros((self.size, self.idle + 1), np.int64)
        self.ends[:, 1] = 1
        for state in range(self.size):
            at = state % (found + 1)
            for k, c in enumerate(["\0", "\n", *letters]):
                if at < found:
                    read = begun[at] + c
                    to = found if any(read.endswith(m) for m in self.markers) else next(begun.index(read[i:]) for i in range(len(read) + 1) if read[i:] in begun)
                else:
                    to = found
                self.step[state, k] = to if c == "\n" else to + found + 1
            self.step[state, self.idle] = state


class Scan:
    """A chunk read from every state at once: for each block of steps, its state and units ended by entry state."""

    def __init__(self, automaton: Automaton, text: str) -> None:
        self.a, self.n = automaton, len(text)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        classes = automaton.class_of[np.minimum(codes, 128)]
        keep = classes != 0
        keep[1:] |= classes[:-1] != 0
        keep[:1] = True
        self.at = np.flatnonzero(keep)
        self.grid = np.full((-(-len(self.at) // BLOCK), BLOCK), automaton.idle, np.uint8)
        self.grid.ravel()[: len(self.at)] = classes[self.at]
        self.to = np.tile(np.arange(automaton.size, dtype=np.uint8), (len(self.grid), 1))
        self.units = np.zeros(self.to.shape, np.int64)
        for j in range(BLOCK):
            c = self.grid[:, j, None]
            self.units += automaton.ends[self.to, c]
            self.to = automaton.step[self.to, c]

    def function(self) -> tuple[np.ndarray, np.ndarray]:
        """By entry state: the state at the end, and the units that ended."""
        to, units = self.to, self.units
        if not len(to):
            return np.arange(self.a.size), np.zeros(self.a.size, np.int64)
        while len(to) > 1:
            odd_to, odd_units = (to[-1:], units[-1:]) if len(to) % 2 else (to[:0], units[:0])
            pairs = len(to) // 2 * 2
            first, second = to[:pairs:2].astype(np.intp), to[1:pairs:2]
            units = np.concatenate([units[:pairs:2] + np.take_along_axis(units[1:pairs:2], first, 1), odd_units])
            to = np.concatenate([np.take_along_axis(second, first, 1), odd_to])
        return to[0], units[0]

    def place(self, entry: int, unit: int) -> int:
        """The code point after the unit-th unit that ends in this chunk (from 1), if it is entered in that state."""
        states = np.empty(len(self.to), np.intp)
        prefix, d = self.to, 1
        while d < len(prefix):
            prefix = np.concatenate([prefix[:d], np.take_along_axis(prefix[d:], prefix[:-d].astype(np.intp), 1)])
            d *= 2
        states[:1], states[1:] = entry, prefix[:-1, entry]
        done = np.cumsum(self.units[np.arange(len(states)), states])
        b = int(np.searchsorted(done, unit))
        left, state = unit - (int(done[b - 1]) if b else 0), int(states[b])
        for j in range(BLOCK):
            c = self.grid[b, j]
            left -= int(self.a.ends[state, c])
            if not left:
                return int(self.at[b * BLOCK + j]) + 1
            state = self.a.step[state, c]
        raise ValueError("no such unit")


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from the seed and a key."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def chosen(key: str, n: int, whole: bool, seed: int, rate: int, spm: int) -> tuple[str, int, int]:
    """Form, and the units of the text that the prefix and the prefix with the middle have. whole: it can't be cut."""
    h1, h2, h3, h4 = draws(key, seed)
    if not n or whole or h3 % 100 >= rate:
        return "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < spm else "psm"), a, b


def assembled(text: str, form: str, a: int, b: int, markers: Sequence[str] = MARKERS) -> str:
    p, s, m = markers
    if form == "plain":
        return text
    if form == "psm":
        return f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"
    return f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output was made of. A text with a marker in it stays plain, so the first of each is its own."""
    p, s, m = (f"\\Q{x}\\E" for x in markers)
    psm = F.regexp_replace(output, F.lit(f"(?s)^{p}(.*?){s}(.*?){m}(.*)$"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)^{s}(.*?){p}(.*?){m}(.*)$"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


_CUT = "n long, form string, prefix_chars long, middle_chars long"


def _giant_cuts(giants: DataFrame, automaton: Automaton, chunk: int, seed: int, rate: int, spm: int) -> DataFrame:
    """_key, n, form, prefix_chars, middle_chars of each different giant (_key, _id, _text)."""
    size, whole = automaton.size, automaton.found

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(-(-len(text) // chunk)):
                    yield pa.RecordBatch.from_pydict({"_key": [key], "_id": [own], "k": pa.array([k], pa.int32()), "chunk": [text[k * chunk : (k + 1) * chunk]]})

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(text), *Scan(automaton, text).function()) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([g[0] for g in got], pa.int64()), pa.array([[int(x) for x in g[1]] for g in got], pa.list_(pa.int32())), pa.array([[int(x) for x in g[2]] for g in got], pa.list_(pa.int64()))], names=["_key", "_id", "k", "chars", "to", "units"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, own, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state, n, at, entries = 0, 0, 0, []
                for part in parts:
                    entries.append((part["k"], state, n, at))
                    n, at, state = n + part["units"][state], at + part["chars"], part["to"][state]
                ended, n = n, n + int(automaton.open[state])
                form, a, b = chosen(own, n, bool(whole[state]), seed, rate, spm)
                for which, unit in ((0, a), (1, b)):
                    # The unit ends in the last chunk before which fewer have ended; the first and last cut need no search.
                    k, entry, before, begin = entries[int(np.searchsorted([e[2] for e in entries], unit)) - 1] if 0 < unit <= ended else (None, 0, 0, at if unit else 0)
                    out.append((key, n, form, which, k, entry, unit - before, begin))
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["_key", "n", "form", "which", "k", "entry", "unit", "begin"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            at = [r["begin"] + Scan(automaton, r["chunk"]).place(r["entry"], r["unit"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("n"), batch.column("form"), batch.column("which"), pa.array(at, pa.int64())], names=["_key", "n", "form", "which", "at"])

    chunks, _ = scratch(giants.mapInArrow(split, "_key string, _id string, k int, chunk string").dropDuplicates(["_key", "k"]), "fim-chunks")
    functions = chunks.select("_key", "_id", "k", "chunk").mapInArrow(summarise, "_key string, _id string, k int, chars long, to array<int>, units array<long>")
    # A text of 2 GB, the most that a row holds, has 32,768 chunks: a text's functions fit into one row.
    parts = functions.groupBy("_key", "_id").agg(F.array_sort(F.collect_list(F.struct("k", "chars", "to", "units"))).alias("parts"))
    wanted, _ = scratch(parts.mapInArrow(resolve, "_key string, n long, form string, which int, k int, entry int, unit long, begin long"), "fim-wanted")
    searched = _joined(chunks.select("_key", "k", "chunk"), wanted.where("k is not null"), ["_key", "k"])
    found = searched.select("_key", "chunk", "n", "form", "which", "entry", "unit", "begin").mapInArrow(select, "_key string, n long, form string, which int, at long")
    both = found.unionByName(wanted.where("k is null").select("_key", "n", "form", "which", F.col("begin").alias("at")))
    cuts = both.groupBy("_key", "n", "form").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    cut = F.col("form") != "plain"
    return cuts.select("_key", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"))


def _joined(large: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """large with small's rows, which are sent to every task only if they are few."""
    return large.join(F.broadcast(small) if small.count() <= SENT else small, on)


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", markers: Sequence[str] = MARKERS, seed: int = SEED, rate: int = RATE, spm: int = SPM, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of df: id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output.

    `rate` of 100 documents are cut, `spm` of 100 of those begin with the suffix. Empty texts, and those with a marker in
    them, stay plain. A null text is empty; a null id draws its numbers from the empty string; rows with one id have
    the same draws and are each cut by their own lines. Repeated rows stay. Other columns are not read. Texts over
    `chunk` code points are scanned in chunks by many tasks, each different one once."""
    automaton, id_type = Automaton(markers), df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), text.alias("_text"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for own, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    scan = Scan(automaton, text)
                    to, units = scan.function()
                    ended, n = int(units[0]), int(units[0]) + int(automaton.open[to[0]])
                    form, a, b = chosen(own, n, bool(automaton.found[to[0]]), seed, rate, spm)
                    a, b = (scan.place(0, u) if 0 < u <= ended else len(text) if u else 0 for u in (a, b))
                    cut = form != "plain"
                    out.append((n, form, a if cut else None, b - a if cut else None, assembled(text, form, a, b, markers)))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    done = rows.where(F.length("_text") <= chunk).mapInArrow(small, f"`{id_col}` {id_type}, {_CUT}, output string")
    giants = rows.where(F.length("_text") > chunk).withColumn("_key", null_safe_key("_id", "_text"))
    cuts, _ = scratch(_giant_cuts(giants.select("_key", "_id", "_text"), automaton, chunk, seed, rate, spm), "fim-cuts")
    p, s, m = (F.lit(x) for x in markers)
    begin, middle = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, mid, suffix = F.substring("_text", F.lit(1), begin), F.substring("_text", begin + 1, middle), F.substring("_text", begin + middle + 1, F.length("_text"))
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, mid)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, mid)).otherwise(F.col("_text"))
    return done.unionByName(_joined(giants, cuts, ["_key"]).select(id_col, "n", "form", "prefix_chars", "middle_chars", output.alias("output")))


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text restored from it; nulls,
    empty texts, repeated rows and other columns as transform() has them."""
    sha = lambda c: F.sha2(c, 256)
    return transform(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
l as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as lines,
        ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, len(lines)::bigint as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from l),
p as (select *, coalesce(array_to_string(lines[1:a], ''), '') as prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') as middle, coalesce(array_to_string(lines[b + 1:], ''), '') as suffix from c)
select doc_id, n, form,
    case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from p
"""
