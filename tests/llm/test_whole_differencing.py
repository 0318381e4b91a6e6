"""The bit-parallel alignment on repeated lines, template lines of marked pages, and heavy templates."""

import random
import time

import pytest

from tilewright.llm import pages


def brute(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("bits", [0, 64, 1 << 24])
def test_alignment(monkeypatch, bits):
    monkeypatch.setattr(pages, "TRACE_BITS", bits)
    rng = random.Random(bits)
    for _ in range(150):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2))
        got = sorted(pages.shared(a, b))
        assert len(got) == brute(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)  # a common subsequence


def test_equal_lines_by_the_thousand():
    began = time.perf_counter()
    assert len(pages.shared([1, *[7] * 50_000, 2], [3, *[7] * 40_000, 4])) == 40_000
    assert time.perf_counter() - began < 20


def test_marked_pages_are_compared_outside(spark):
    html = "<nav><a>Home</a><p>Menu {0}</p></nav><p>Welcome to the site</p><article><p>A quote</p><p>Own {0}</p></article><footer>Bye</footer>"
    rows = [(i, f"http://h.com/{i}", html.format(i)) for i in range(6)] + [(9, "http://z.com/9", html.format(9))]
    out = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i].text == f"A quote\n\nOwn {i}" and out[i].n_deleted == (3 if i < 6 else 0) for i in out)


def test_short_texts_in_a_heavy_template(spark):
    lines = "".join(f"<p>Line {i} of what stands on every page of this host</p>" for i in range(20))
    rows = [(i, f"http://h.com/{i}", f"{lines}<p>Only {i}</p>{lines}") for i in range(6)]
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"Only {i}" for i in range(6)}


@pytest.mark.parametrize("parts", [1, 16])
def test_marked_pages_are_compared_as_a_whole(spark, parts):
    """Pages that differ in their marked articles only have a template; what the articles share is found and stays. Pages
    without marks aren't compared with articles."""
    html = "<body><nav>Home</nav><p>Welcome</p><article><p>A quote</p><p>Own words of page {0}</p></article><p>Bye</p></body>"
    bare = "<body><p>Welcome</p><p>A quote</p><p>Other words</p><p>Bye</p></body>"
    rows = [(i, f"http://h.com/{i}", html.format(i)) for i in range(8)] + [(20, "http://g.com/0", html.format(20)), (21, "http://g.com/1", bare)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all((out[i].text, out[i].n_deleted, out[i].n_kept) == (f"A quote\n\nOwn words of page {i}", 3, 1) for i in range(8))
    assert (out[20].text, out[20].n_deleted, out[20].n_kept) == ("A quote\n\nOwn words of page 20", 2, 1)
    assert (out[21].text, out[21].n_deleted, out[21].n_kept) == ("A quote\n\nOther words", 2, 0)
