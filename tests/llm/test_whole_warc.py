"""Archives: what is read back, the format, equal bytes on every run, rolled files and commits that broke off."""

import base64
import gzip
import hashlib
import os
import re

import pytest

from tilewright.llm import warc

SCHEMA = "page_id long, url string, html string, first string, _id string, _segment int"


def rows_of():
    out = [(i, f"http://h{i % 3}.org/p {i}", f"<p>page {i} é {'x' * (i * 37 % 900)}</p>") for i in range(60)]
    out += [(100 + i, f"http://copy.org/{i}", "<p>the same page</p>" * 40) for i in range(40)]
    out += [(200, None, None), (201, "", ""), (202, "u\r\nWARC-Type: forged\r\n\r\n", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (203, "u%20", "long" * 60_000)]
    out += [(5, "http://again.org", "<p>page 5 other</p>"), (100, "http://copy.org/0", "<p>the same page</p>" * 40), (None, None, "<p>the same page</p>" * 40), (None, "n", "only null ids"), (None, "m", "only null ids")]
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "a", "b", 3) for r in rows_of()], SCHEMA)


def expected(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(html or "")
        later = to is not None and (i is None or i > to)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if later else "response", to if later else None))
    return sorted(out, key=repr)


def test_digest(spark, pages):
    out = warc.digest(pages)
    assert [(c, t) for c, t in out.dtypes] == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    assert sorted([tuple(r) for r in out.collect()], key=repr) == expected(rows_of())
    assert warc.digest(pages.limit(0)).collect() == []


def files_of(folder):
    names = sorted(os.listdir(f"{folder}/data"))
    return [n for n in names if not n.endswith(".crc")], {n: open(f"{folder}/data/{n}", "rb").read() for n in names if not n.endswith(".crc")}


def test_equal_bytes_in_small_segments(spark, pages, tmp_path):
    a = warc.write(pages, str(tmp_path / "a"), segment_bytes=20_000, file_bytes=2_000)
    warc.write(pages.repartition(7), f"file://{tmp_path}/b", segment_bytes=20_000, file_bytes=2_000)
    names, data = files_of(tmp_path / "a")
    assert len({n[:8] for n in names}) > 4 and any(n[9:14] != "00000" for n in names)
    # The page that is heavier than a segment has one, so that all files are the same.
    assert data == files_of(tmp_path / "b")[1]
    listed = {r.name: r for r in a.collect()}
    assert {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in data.items()} == {n: (r.bytes, r.sha256) for n, r in listed.items()}
    assert sum(r.records for r in listed.values()) == pages.count()
    got = warc.read(spark, str(tmp_path / "a"), payload=True).collect()
    assert sorted([(None if r.id is None else int(r.id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got], key=repr) == expected(rows_of())
    urls = {(None if r.id is None else int(r.id), r.url) for r in got}
    assert urls == {(i, u) for i, u, _ in rows_of()}
    html = {(i, u): h or "" for i, u, h in rows_of()}
    assert all(r.payload is None if r.record_type == "revisit" else r.payload.decode() == html[(None if r.id is None else int(r.id), r.url)] for r in got)
    # Records lie in the order of the ids, within a file and from file to file.
    ids = [int(m) for n in names for m in re.findall(rb"\r\nPage-ID: (\d+)\r\n", gzip.decompress(data[n]))]
    assert ids == sorted(ids)


def test_format(spark, pages, tmp_path):
    warc.write(pages, str(tmp_path / "w"))
    names, data = files_of(tmp_path / "w")
    text = gzip.decompress(data[names[0]])
    at, kinds = 0, []
    while at < len(text):
        head, _, _ = text[at:].partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        assert lines[0] == "WARC/1.1" and {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length"} <= fields.keys()
        block = text[at + len(head) + 4 :][: int(fields["Content-Length"])]
        assert fields["WARC-Block-Digest"] == "sha1:" + warc.sha1(block)
        if fields["WARC-Type"] == "revisit":
            assert fields["WARC-Profile"].endswith("identical-payload-digest") and fields["WARC-Refers-To"].startswith("<urn:uuid:") and block.endswith(b"\r\n\r\n")
        kinds.append(fields["WARC-Type"])
        at += len(head) + 4 + len(block) + 4
    assert kinds[0] == "warcinfo" and set(kinds) == {"warcinfo", "response", "revisit"}


def test_responses_below_a_size(spark, pages, tmp_path):
    warc.write(pages, str(tmp_path / "m"), min_revisit=1_000)
    got = warc.read(spark, str(tmp_path / "m")).collect()
    assert sorted([(None if r.id is None else int(r.id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got], key=repr) == expected(rows_of(), 1_000)


def test_commit_again_and_lost_files(spark, pages, tmp_path):
    folder = str(tmp_path / "c")
    warc.write(pages, folder, segment_bytes=20_000)
    names, data = files_of(folder)
    # As if the first commit had broken off: one file still has its temporary name, and an attempt left another.
    temporary = {r.name: r.temporary for r in warc.manifest(spark, folder).collect()}
    os.makedirs(f"{folder}/temporary")
    os.rename(f"{folder}/data/{names[1]}", f"{folder}/temporary/{temporary[names[1]]}")
    open(f"{folder}/temporary/{names[1]}.left", "wb").write(b"half")
    with pytest.raises(ValueError, match="missing"):
        warc.read(spark, folder)
    warc.commit(spark, folder)
    assert files_of(folder)[1] == data and not os.path.exists(f"{folder}/temporary")
    assert warc.read(spark, folder).count() == pages.count()


def test_an_id_heavier_than_a_segment(spark, tmp_path):
    rows = [(1, "u", "x" * 5_000)] * 40 + [(i, "v", f"p{i}") for i in range(2, 30)]
    folder = str(tmp_path / "h")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}-in")
    warc.write(spark.read.parquet(f"{folder}-in"), folder, segment_bytes=30_000)
    got = warc.read(spark, folder)
    assert got.where("id = 1 and record_type = 'response'").count() == 40 and got.count() == len(rows)
    assert len({n[:8] for n in files_of(folder)[0]}) > 5


def test_string_ids(spark, tmp_path):
    df = spark.createDataFrame([(f"é{i:03}", None, f"h{i % 40}" * 100) for i in range(120)], "page_id string, url string, html string")
    warc.write(df, str(tmp_path / "s"), segment_bytes=4_000)
    got = {r.id: r.refers_to for r in warc.read(spark, str(tmp_path / "s")).collect()}
    assert got == {f"é{i:03}": None if i < 40 else f"é{i % 40:03}" for i in range(120)}
