"""Page differencing where pages differ in the query only, and past runs of copies."""

import pytest

from tilewright.llm import pages

BODY = "<body><div>Welcome to this site</div><p>{0}</p><div>Read the rules</div>"


def texts(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pages_of_one_path(spark):
    said = {i: f"What stands on page {i} only, number {i * i}" for i in range(5)}
    rows = [(i, f"http://h.com/index.php?id={i}", BODY.format(x)) for i, x in said.items()]
    rows += [(10 + i, "http://q.com?x", BODY.format(x)) for i, x in said.items()]
    assert texts(spark, rows, 4) == said | {10 + i: x for i, x in said.items()}


@pytest.mark.parametrize("parts", [1, 16])
def test_copies_are_passed_over(spark, parts):
    copy = "The article that was copied many times over " * 3
    rows = [(i, f"http://h.com/a/{i:03}", BODY.format(copy)) for i in range(60)]
    rows += [(100, "http://h.com/b", BODY.format("Another one that is quite different " * 3)), (101, "http://g.com/", BODY.format(copy))]
    got = texts(spark, rows, parts)
    assert all(got[i] == copy.strip() for i in range(60)) and got[100].startswith("Another") and got[100].count("\n") == 0
    assert got[101] == "\n\n".join(["Welcome to this site", copy.strip(), "Read the rules"])


def test_differencing_decides_where_no_article_is_marked(spark):
    """A line that the neighbours share stays in a marked article and goes from a page without marks."""
    html = "<body><{0}><p>A passage on every page</p><p>Own words of page {1}, {1} times over</p></{0}></body>"
    rows = [(10 * k + i, f"http://h{k}.com/{i}", html.format(tag, i)) for k, tag in enumerate(("article", "div")) for i in range(4)]
    got = texts(spark, rows, 4)
    own = {i: f"Own words of page {i}, {i} times over" for i in range(4)}
    assert got == {i: f"A passage on every page\n\n{x}" for i, x in own.items()} | {10 + i: x for i, x in own.items()}
