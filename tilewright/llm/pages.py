"""Main text of web pages by nearest-URL differencing.

A page's lines are its blocks of text. A page is paired with the page of the nearest URL
(path and query) on its host, the two are aligned by the longest common subsequence of
their lines, and the shared lines are deleted. Elements whose tag, role, class or id says
that they are menus, headers, footers, sidebars, notices, adverts, forms or comments are
left out as well, shared or not, and if the page marks its article (article or main
elements) that alone is kept. Such a page is aligned as a whole like any other, and then
gets back what differencing took from its article: what pages share outside of it is
template, what they share inside are quotes and copies. To pages without marks it shows
its lines outside of the article only. Pages without such marks
that share COPY of their text may be copies of one article: a run of copies is passed over
to the next page on either side that differs, if there is one, else compared as it is;
pages with equal lines say nothing about each other."""

from __future__ import annotations

import html as html_lib
import pickle
import re
from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import null_safe_key, scratch

COPY = 0.8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title|xmp)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</[^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|(?<![\w=-])(hidden)(?![\w=-])", re.IGNORECASE)

# Elements of HTML by what they do here, and words of classes, ids and roles that aren't article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form button select option fieldset menu dialog object applet canvas audio video map head datalist".split())
BLOCK = frozenset(
    "html body head title p div section article main header footer nav aside form h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption "
    "blockquote pre figure figcaption hr address fieldset details summary menu dialog center noscript legend".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = frozenset("br td th option".split())
WORDS = frozenset(
    "nav navbar navigation menu submenu header masthead topbar footer bottom sidebar aside rail ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert warning disclaimer comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar copyright legal search skip hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())
#: Where a paragraph that is still open ends.
_ENDS_P = BLOCK - {"html", "head", "title"}


def _unwanted(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, a, b, c, hidden in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if hidden or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and not WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def blocks(source: str) -> list[tuple[str, bool, bool]]:
    """(text, whether it is wanted, whether it stands in an article or main element) of each block of a page."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    # Open elements: tag, whether its text is unwanted, whether it is in a marked article.
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    heading = False  # in a heading of an article's own header, which is wanted

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, not stack[-1][1] or heading, stack[-1][2]))

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            parts.append(source[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in SPACED:
            parts.append(" ")
        if tag in BLOCK or tag in DROPPED:
            flush()
        if m["end"] or m["end2"]:
            if tag in HEADINGS:
                heading = False
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        bad, marked = stack[-1][1], stack[-1][2]
        if tag in ("article", "main"):
            if bad and stack[-1][0] in ("nav", "header") and not marked:  # that one was never closed
                bad = False
            bad = bad or _unwanted(tag, attrs)
            marked = True
        elif bad:
            heading = tag in HEADINGS and marked and stack[-1][0] == "header"
        else:
            bad = _unwanted(tag, attrs)
        stack.append((tag, bad, marked))
    if at < len(source):
        parts.append(source[at:])
    flush()
    return out


class Lines(NamedTuple):
    """A page as it is compared: text are its wanted lines (those of its article, if it marks one), mine the hashes of all
    lines and at the places of text in mine. sizes are those of the wanted lines, the rest being 0; of a page that marks
    its article they are 1 inside of the marks and 0 outside."""

    text: list[str]
    marked: bool
    at: list[int]
    mine: list[int]
    sizes: list[int]


def lines_of(source: str) -> Lines:
    found = blocks(source)
    mine = [_hash(t) for t, _, _ in found]
    inside = any(wanted and marked for _, wanted, marked in found)
    at = [i for i, (_, wanted, marked) in enumerate(found) if wanted and (marked or not inside)]
    sizes = [int(marked) if inside else len(t) if wanted else 0 for t, wanted, marked in found]
    return Lines([found[i][0] for i in at], inside, at, mine, sizes)


#: Bits of the alignment that are kept at a time to trace a longest common subsequence back.
TRACE_BITS = 1 << 24


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of a: a number whose bit j is 0 where the longest common subsequence with b grows at b[j]."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
        yield v


def _grown(v: int, n: int) -> np.ndarray:
    """Lengths with the first 0 to n lines."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), count=n, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(mine: list[int], other: list[int]) -> set[int]:
    """Positions in mine of a longest common subsequence with other.

    Equal ends are taken off, the rest is aligned with one bit a pair of lines; where that is more than TRACE_BITS,
    mine is halved at the best split of other (equal lines by the thousand cost no more than different ones)."""
    out: set[int] = set()
    todo = [(0, len(mine), 0, len(other))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and mine[a] == other[c]:
            out.add(a)
            a, c = a + 1, c + 1
        while a < b and c < d and mine[b - 1] == other[d - 1]:
            b, d = b - 1, d - 1
            out.add(b)
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= TRACE_BITS or b - a == 1:
            rows = list(_rows(mine[a:b], other[c:d]))
            i, j = b - a, d - c
            while i and j:
                if rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                    continue
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    out.add(a + i)
                    j -= 1
        else:
            half = (a + b) // 2
            *_, first = _rows(mine[a:half], other[c:d])
            *_, second = _rows(mine[half:b][::-1], other[c:d][::-1])
            cut = c + int(np.argmax(_grown(first, d - c) + _grown(second, d - c)[::-1]))
            todo += [(a, half, c, cut), (half, b, cut, d)]
    return out


def _hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def deleted(mine: list[int], sizes: list[int], marked: bool, candidates: list[list[int]]) -> set[int]:
    """Positions of the lines that the neighbour shares: of the candidates, nearest first, the first that isn't a copy
    by COPY of the text; without one, the first that differs at all. A marked article's page is no copy of others."""
    first = None
    for other in candidates:
        if mine == other:
            continue
        got = shared(mine, other)
        if marked or sum(sizes[i] for i in got) < COPY * sum(sizes):
            return got
        first = got if first is None else first
    return first or set()


def _host_path(url):
    """Host and path with query of a URL column; a null or relative URL has no host."""
    bare = F.regexp_replace(url, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", ""), F.lit(""))


def neighbours(keys: DataFrame) -> DataFrame:
    """(host, path, near) from (host, path, rep), one row a path: rep of the path before or after, in order within the
    host, with which the path has the longer common beginning; null on hosts with one path.

    The order is cut into ranges, so that a large host is many tasks'; each range's first and last rows, two a task,
    find theirs in one small window."""
    schema = pa.schema([(n, pa.string()) for n in ("host", "path", "rep", "bh", "bp", "br", "ah", "ap", "ar")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None, None, None)
        before, now = none, None
        for batch in batches:
            rows = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now:
                    rows.append((*now, *before, *r))
                    before = now
                now = r
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (*now, *before, *none)], schema=schema)

    ranges = keys.select("host", "path", "rep").repartitionByRange("host", "path").sortWithinPartitions("host", "path")
    led, _ = scratch(ranges.mapInArrow(run, ", ".join(f"{n} string" for n in schema.names)), "pages-near")
    edge = F.col("br").isNull() | F.col("ar").isNull()
    w = Window.orderBy("host", "path")
    edges = led.where(edge).select("host", "path", "rep", *[F.coalesce(c, f(o).over(w)).alias(c) for c, o, f in (("bh", "host", F.lag), ("bp", "path", F.lag), ("br", "rep", F.lag), ("ah", "host", F.lead), ("ap", "path", F.lead), ("ar", "rep", F.lead))])
    every = led.where(~edge).unionByName(edges)
    x = F.when(F.col("bh") == F.col("host"), _common(F.col("path"), F.col("bp")))
    y = F.when(F.col("ah") == F.col("host"), _common(F.col("path"), F.col("ap")))
    near = F.when(x.isNotNull() & (y.isNull() | (x >= y)), F.col("br")).when(y.isNotNull(), F.col("ar"))
    return every.select("host", "path", near.alias("near"))


def _common(a, b):
    """Code points that two strings have in common at the beginning."""
    return F.length(F.regexp_extract(F.concat(a, F.lit("\n"), b), r"(?s)^(.*)[^\n]*\n\1", 1))


#: Pages to compare with: on which side each lies (0 before, 1 after), its path and the hashes of its lines.
_NEAR = pa.list_(pa.struct([("side", pa.int32()), ("path", pa.string()), ("lines", pa.list_(pa.int64()))]))
#: A page that its range settles has gone; one whose neighbours may lie in other ranges has what the rest needs.
_PLACED = pa.schema([("_rid", pa.string()), ("gone", pa.list_(pa.int32())), ("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("marked", pa.bool_()), ("mine", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("near", _NEAR), ("edge", pa.binary())])
_PLACED_SQL = "_rid string, gone array<int>, part int, first boolean, last boolean, marked boolean, mine array<bigint>, sizes array<int>, near array<struct<side:int,path:string,lines:array<bigint>>>, edge binary"


class _Page(NamedTuple):
    host: str
    path: str
    rid: str
    marked: bool
    lines: list[int]
    sizes: list[int]

    def copies(self, other: _Page) -> bool:
        """Whether neither marks its article and the lines that both have are COPY of the text of either."""
        if self.marked or other.marked:
            return False
        both = shared(self.lines, other.lines) if self.lines != other.lines else range(len(self.lines))
        return sum(self.sizes[i] for i in both) >= COPY * min(sum(self.sizes), sum(other.sizes))


    def shown(self, to: _Page) -> list[int]:
        """The lines that a page is compared with: to one without marks, those outside of a marked article."""
        return [x for x, n in zip(self.lines, self.sizes, strict=True) if not n] if self.marked and not to.marked else self.lines


def _near(found: list[tuple[int, _Page | None]], to: _Page) -> list[dict]:
    return [{"side": i, "path": p.path, "lines": p.shown(to)} for i, p in found if p]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the pages of a range in order, the lines that the pages next to each and to its run of copies delete; in the
    first and the last run, the pages to compare with. The last row's edge has the first and last page, the number of
    runs, and the pages after the first and before the last run."""
    part = TaskContext.get().partitionId()
    out: list[dict] = []
    run: list[tuple[_Page, _Page | None, _Page | None]] = []  # the run's pages, each between its neighbours
    head = prev = older = before = after_first = None
    n = 0
    nothing = dict.fromkeys(_PLACED.names)

    def close(after: _Page | None, last: bool) -> None:
        for page, a, b in run:
            near = _near([(0, a), *([(0, before)] if before is not a else []), (1, b), *([(1, after)] if after is not b else [])], page)
            row = nothing | {"_rid": page.rid, "part": part, "first": n == 1, "last": last}
            if n == 1 or last:
                out.append(row | {"marked": page.marked, "mine": page.lines, "sizes": page.sizes, "near": near})
            else:
                out.append(row | {"gone": sorted(deleted(page.lines, page.sizes, page.marked, _nearest_first(page.path, near)))})
        run.clear()

    for batch in batches:
        for page in map(_Page._make, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if prev is None:
                head, n = page, 1
            else:
                same = page if page.host == prev.host else None
                run.append((prev, older, same))
                if not (same and page.copies(prev)):
                    close(same, False)
                    if n == 1:
                        after_first = same
                    n, before = n + 1, prev if same else None
                older = prev if same else None
            prev = page
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=_PLACED)
                out.clear()
    if prev is not None:
        run.append((prev, older, None))
        close(None, True)
        edge = pickle.dumps([x and tuple(x) for x in (head, prev, after_first, before if n > 1 else None)] + [n])
        out.append(nothing | {"part": part, "edge": edge})
        yield pa.RecordBatch.from_pylist(out, schema=_PLACED)


def _borders(edges: list[tuple[int, bytes]]) -> dict[int, tuple[list[dict], list[dict]]]:
    """By range, the pages of other ranges that come before its first and after its last run."""
    parts = [(k, *[x and _Page(*x) for x in e[:4]], e[4]) for k, e in sorted((k, pickle.loads(e)) for k, e in edges)]
    sides = []
    for side, order in ((0, parts), (1, parts[::-1])):
        found: dict[int, list[dict]] = {}
        far, last = None, None
        for k, head, tail, after_first, before_last, n in order:
            mine, theirs = (head, last and last[2]) if side == 0 else (tail, last and last[1])
            if theirs is None or theirs.host != mine.host:
                far, near = None, []
            elif mine.copies(theirs):
                if last[5] > 1:
                    far = last[4] if side == 0 else last[3]
                near = [(side, theirs), (side, far)]
            else:
                far, near = theirs, [(side, theirs)]
            found[k] = _near(near, mine)
            last = (k, head, tail, after_first, before_last, n)
        sides.append(found)
    return {k: (sides[0][k], sides[1][k]) for k in sides[0]}


def _nearest_first(path: str, near: list[dict]) -> list[list[int]]:
    """The lines of the candidates by the length of the beginning that their paths have in common with path."""
    return [c["lines"] for c in sorted(near, key=lambda c: (-len(commonprefix([path, c["path"]])), c["side"]))]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of df: id, url, text, n_chars, n_deleted (lines that the neighbour shares, menus and the
    like among them), n_kept (lines of a marked article that the neighbour shares and that stay).

    A null or empty page has the empty text. Pages with null URLs, and those alone on their host, are not compared.
    Repeated rows stay and get equal texts. Pages of one URL are neighbours of each other. Other columns are not read.
    A host's pages are dealt out in ranges of their order; the ends of the ranges, four pages each, meet in the driver."""
    host, path = _host_path(F.col(url_col))
    pages = df.select(id_col, url_col, html_col).withColumn("_host", host).withColumn("_path", path).withColumn("_rid", null_safe_key(id_col, url_col, html_col))
    id_type = df.schema[id_col].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lines_of(s or "") for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([g.marked for g in got]), pa.array([g.mine for g in got], pa.list_(pa.int64())), pa.array([g.sizes for g in got], pa.list_(pa.int32()))], names=["host", "path", "_rid", "marked", "lines", "sizes"])

    lines = pages.where("_host <> ''").select("_host", "_path", "_rid", html_col).mapInArrow(hashes, "host string, path string, _rid string, marked boolean, lines array<long>, sizes array<int>").where(F.when(F.col("marked"), F.array_contains("sizes", 0)).otherwise(F.size("lines") > 0)).dropDuplicates(["_rid"])
    ranges = lines.repartitionByRange("host", "path", "_rid").sortWithinPartitions("host", "path", "_rid")
    placed, _ = scratch(ranges.mapInArrow(_placed, _PLACED_SQL), "pages-near")
    borders = df.sparkSession.sparkContext.broadcast(_borders([(r.part, bytes(r.edge)) for r in placed.where("edge is not null").select("part", "edge").collect()]))
    near = placed.where("_rid is not null").drop("edge")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lines_of(s or "") for s in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([g.text for g in got], pa.list_(pa.string())), pa.array([g.at for g in got], pa.list_(pa.int32())), pa.array([g.marked for g in got])], names=[id_col, url_col, "_path", "_rid", "_text", "_at", "_marked"])

    texts = pages.select(id_col, url_col, "_path", "_rid", html_col).mapInArrow(wanted, f"`{id_col}` {id_type}, `{url_col}` string, _path string, _rid string, _text array<string>, _at array<int>, _marked boolean")
    both = texts.join(near, "_rid", "left").select(id_col, url_col, "_path", "_text", "_at", "_marked", "gone", "part", "first", "last", "marked", "mine", "sizes", "near")

    def settled(path, gone, part, first, last, marked, mine, sizes, near) -> set[int]:
        if near is None:
            return set(gone or ())
        before, after = borders.value[part]
        return deleted(mine, sizes, marked, _nearest_first(path, near + (before if first else []) + (after if last else [])))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out, n, stay = [], [], []
                for path, text, places, whole, *rest in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True):
                    gone = settled(path, *rest)
                    kept = gone.intersection(places) if whole else set()
                    out.append("\n\n".join([x for x, i in zip(text, places, strict=True) if i in kept or i not in gone]))
                    n.append(len(gone) - len(kept))
                    stay.append(len(kept))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64()), pa.array(n, pa.int64()), pa.array(stay, pa.int64())], names=[id_col, url_col, "text", "n_chars", "n_deleted", "n_kept"])

    return both.mapInArrow(joined, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long, n_deleted long, n_kept long")
