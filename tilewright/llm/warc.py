"""WARC archives of pages: a deterministic writer in shards, and a reader.

Records are sorted by id and cut into segments at fixed sums of their sizes, so the same pages
give the same files, whatever the cluster. A task writes whole segments; it rolls to the next
file when the compressed size of one is reached. Headers and digests are made anew. Of equal
payloads the record with the least id is a response, the others revisit it.

Files are written under temporary names. The rows that say what was written, which Spark keeps
of one attempt of a task only, are the manifest; what it lists gets its name, by renames that
may be repeated, and what failed attempts left goes with the temporary folder."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import checkpoint_dir, drop_scratch, scratch

#: Payload and header bytes of a segment, the work of a task, and compressed bytes after which a file is closed.
SEGMENT_BYTES, FILE_BYTES = 64 << 20, 16 << 20
#: What a record's headers count for.
HEADER_BYTES = 512
#: Records of smaller payloads are responses even if there are equal ones.
MIN_REVISIT = 0
#: Pages don't say when they were fetched; archives of the same pages are to be equal.
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Partitions that a writing job has at most; more segments share them.
PARTITIONS = 20_000


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A header's value: white space and control characters would end or change it."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _unfield(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_id(page: str | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page, url, digest)))}>"


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member of its own; the member has no time and no name."""
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"WARC-Block-Digest: sha1:{sha1(block)}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def page_record(page: str | None, url: str | None, payload: bytes, first: tuple[str | None, str | None] | None) -> bytes:
    """first: id and URL of the response that this record revisits. A revisit has the HTTP headers without the payload."""
    digest = sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", record_id(page, url, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-ID", None if page is None else _field(page)),
        ("Page-URL", None if url is None else _field(url)),
    ]
    if first is None:
        return record("response", headers, http + payload)
    to, to_url = first
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(to, to_url, digest)), ("WARC-Refers-To-Target-URI", None if to_url is None else _uri(to_url)), ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-ID", None if to is None else _field(to))]
    return record("revisit", headers, http)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a compressed file."""
    with io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive))) as f:
        while line := f.readline():
            if line.strip() != VERSION.encode():
                raise ValueError(f"not a record: {line[:40]!r}")
            headers = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode().partition(":")
                headers[k.strip().lower()] = v.strip()
            block = f.read(int(headers["content-length"]))
            if f.read(4) != b"\r\n\r\n" or f"sha1:{sha1(block)}" != headers["warc-block-digest"]:
                raise ValueError(f"damaged record {headers.get('warc-record-id')}")
            yield headers, block


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Files:
    """The files of one task's segments, under temporary names."""

    def __init__(self, folder: str, file_bytes: int) -> None:
        self.fs, self.folder = _filesystem(folder)
        self.file_bytes, self.attempt, self.done = file_bytes, uuid.uuid4().hex, []
        self.segment, self.number, self.out = None, 0, None

    def add(self, segment: int, data: bytes) -> None:
        if segment != self.segment:
            self.close()
            self.segment, self.number = segment, 0
        if self.out is None:
            self.name = f"{segment:08d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.name}.{self.attempt}"
            self.fs.create_dir(self.folder, recursive=True)
            self.out, self.bytes, self.records, self.sha = self.fs.open_output_stream(f"{self.folder}/{self.temporary}"), 0, 0, hashlib.sha256()
            self._put(record("warcinfo", [("WARC-Record-ID", record_id(None, None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(data)
        self.records += 1
        if self.bytes >= self.file_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temporary, self.bytes, self.records, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


MANIFEST = "name string, temporary string, bytes long, records long, sha256 string"
_MANIFEST_ARROW = pa.schema([("name", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])


def _bounds(light: DataFrame, segment_bytes: int) -> tuple[list, int]:
    """The ids at which a sum of sizes passes a multiple of segment_bytes, as often as they do and have rows for it, and the
    null ids' segments.

    Ids are summed in ranges of their order. The driver gets one id for each segment: 1.6 million for 100 TB."""
    spark = light.sparkSession
    sizes = light.groupBy("_id").agg(F.sum(F.col("n_bytes") + HEADER_BYTES).alias("w"), F.count("*").alias("rows"))
    nulls = sum(r.w for r in sizes.where("_id is null").collect())
    ranges = sizes.where("_id is not null").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_id")
    dealt, path = scratch(ranges.withColumn("_p", F.spark_partition_id()), "warc-order")
    totals = dealt.groupBy("_p").agg(F.sum("w").alias("t"))
    before = totals.select("_p", (F.sum("t").over(Window.orderBy("_p")) - F.col("t")).alias("before"))
    inner = F.sum("w").over(Window.partitionBy("_p").orderBy("_id")) - F.col("w")
    sums = dealt.withColumn("inner", inner).join(F.broadcast(before), "_p").withColumn("at", F.col("inner") + F.col("before"))
    passed = F.floor((F.col("at") + F.col("w")) / segment_bytes) - F.floor(F.col("at") / segment_bytes)
    # An id has no more segments than rows, so that a large record alone has its place.
    found = sums.select("_id", F.least(passed, "rows").cast("int").alias("k")).where("k > 0").orderBy("_id").collect()
    drop_scratch(spark, path)
    return [r._id for r in found for _ in range(r.k)], -(-nulls // segment_bytes)


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of df to folder/data (folder is to be new) and returns the manifest of its files.

    Executors write by the path's own filesystem (file:, hdfs:, s3:, gs:). A null text is an empty payload, a null URL
    has no header. Rows with the least id of equal payloads are responses, several of them if ids repeat; a null id
    comes after all others, and if there is no other, such rows are responses. Other columns are not read. Rows of one
    id heavier than a segment are dealt out over its segments by their place in df, which is to be a table then, so
    that a task run again finds them there. A payload has to fit into a row."""
    spark = df.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_html"), F.sha2(payload, 256).alias("_sha"))
    light, light_path = scratch(rows.select("_id", "_url", "_sha", F.octet_length("_html").cast("long").alias("n_bytes")), "warc-light")
    bounds, null_segments = _bounds(light, segment_bytes)
    at = np.array(bounds, object) if bounds and isinstance(bounds[0], (str, bytes)) else np.array(bounds)
    last = len(bounds) + 1

    @F.arrow_udf("struct<first:int,n:int>")
    def segments(ids: pa.Array) -> pa.Array:
        """The first segment of an id, and how many it has."""
        known = ids.filter(ids.is_valid()).to_numpy(zero_copy_only=False)
        first, n = np.full(len(ids), last, np.int32), np.full(len(ids), max(1, null_segments), np.int32)
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        if len(at):
            left = np.searchsorted(at, known, "left")
            first[valid], n[valid] = left, np.maximum(1, np.searchsorted(at, known, "right") - left)
        else:
            first[valid], n[valid] = 0, 1
        return pa.StructArray.from_arrays([pa.array(first), pa.array(n)], ["first", "n"])

    # Of equal payloads: the least id and its URL. A group whose rows all have the least id has no revisits.
    known = F.when(F.col("_id").isNotNull(), F.struct("_id", "_url"))
    groups = light.where(F.col("n_bytes") >= min_revisit).groupBy("_sha").agg(F.min(known).alias("first"), F.max("_id").alias("most"), F.count("*").alias("rows"), F.count("_id").alias("with_id"))
    firsts, firsts_path = scratch(groups.where((F.col("most") > F.col("first._id")) | ((F.col("with_id") > 0) & (F.col("with_id") < F.col("rows")))).select("_sha", "first"), "warc-firsts")
    later = light.join(firsts, "_sha").where(F.col("_id").isNull() | (F.col("_id") > F.col("first._id"))).select("_id", "_sha", "first").distinct()
    place = segments("_id")
    # One stream in the files' order: what a row revisits stands before it.
    told = later.withColumn("_at", place).select(F.explode(F.sequence("_at.first", F.col("_at.first") + F.col("_at.n") - 1)).alias("_segment"), "_id", "_sha", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_url"), F.lit(None).cast("string").alias("_html"), "first")
    dealt = rows.withColumn("_at", place).withColumn("_segment", F.col("_at.first") + F.when(F.col("_at.n") > 1, F.pmod(F.monotonically_increasing_id(), F.col("_at.n"))).otherwise(0).cast("int"))
    stream = told.unionByName(dealt.select("_segment", "_id", "_sha", F.lit(1).alias("_kind"), "_url", "_html", F.lit(None).cast(firsts.schema["first"].dataType).alias("first")))
    n = min(PARTITIONS, last + null_segments)
    order = ["_segment", "_id", "_sha", "_kind", "_url"]
    stream = stream.repartitionById(n, F.pmod("_segment", F.lit(n))).sortWithinPartitions(*order)
    stream = stream.select("_segment", F.col("_id").cast("string").alias("_id"), "_sha", "_kind", "_url", "_html", F.col("first").isNotNull().alias("_later"), F.col("first._id").cast("string").alias("_to"), F.col("first._url").alias("_to_url"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, told_of = _Files(f"{folder}/temporary", file_bytes), (None, None)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                for r in batch.slice(begin, 256).to_pylist():
                    key = (r["_segment"], r["_id"], r["_sha"])
                    if not r["_kind"]:
                        told_of = (key, (r["_to"], r["_to_url"]))
                    else:
                        files.add(r["_segment"], page_record(r["_id"], r["_url"], r["_html"].encode(), told_of[1] if told_of[0] == key else None))
        files.close()
        yield pa.RecordBatch.from_pydict(dict(zip(_MANIFEST_ARROW.names, list(zip(*files.done, strict=True)) or [()] * 5, strict=True)), schema=_MANIFEST_ARROW)

    stream.mapInArrow(put, MANIFEST).write.parquet(f"{folder}/manifest")
    for path in (light_path, firsts_path):
        drop_scratch(spark, path)
    commit(spark, folder)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def commit(spark: SparkSession, folder: str) -> None:
    """Gives the files of the manifest their names; may be repeated after it broke off. Temporary files go."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = _filesystem(folder)
        where.create_dir(f"{base}/data", recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                to = where.get_file_info(f"{base}/data/{r['name']}")
                if to.type != fs.FileType.File or to.size != r["bytes"]:
                    where.move(f"{base}/temporary/{r['temporary']}", to.path)
            yield batch.select(["name"])

    files = manifest(spark, folder)
    files.repartition("name").mapInArrow(rename, "name string").write.format("noop").mode("overwrite").save()
    drop_scratch(spark, f"{folder}/temporary")


_READ = [("id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """id, url, payload_bytes, payload_digest, record_type, refers_to (an id), and payload if asked for (null of revisits),
    one row for each record of the committed files. Bytes and digest are worked out from a response's payload and
    held against its header; a revisit's headers say what its full payload has. Files that are missing, have another
    size than the manifest says, or hold damaged records raise."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/data") if not manifest(spark, folder).isEmpty() else None
    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _READ) + (", payload binary" if payload else "")
    if files is None:
        return spark.createDataFrame([], schema)
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    lost = manifest(spark, folder).join(there, "name", "left").where(F.col("length").isNull() | (F.col("length") != F.col("bytes")))
    if not lost.isEmpty():
        raise ValueError(f"files of the manifest are missing or cut: {[r.name for r in lost.select('name').limit(10).collect()]}")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[tuple]) -> pa.RecordBatch:
            fields = [*_READ, ("payload", pa.binary())] if payload else _READ
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for h, block in records(batch.column(0)[i].as_py()):
                    if h["warc-type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest, n = h["warc-payload-digest"].removeprefix("sha1:"), int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])
                    if h["warc-type"] == "response":
                        if sha1(body) != digest or len(body) != n:
                            raise ValueError(f"payload of {h['warc-record-id']} differs from its header")
                    own, url, to = (_unfield(h[k]) if k in h else None for k in ("page-id", "page-url", "refers-to-page-id"))
                    rows.append((own, url, n, digest, h["warc-type"], to, body if h["warc-type"] == "response" else None))
                    held += len(body)
                    if held > 8 << 20:
                        yield sent(rows)
                        rows, held = [], 0
                yield sent(rows)

    return files.select("content").mapInArrow(parse, schema)


def digest(df: DataFrame) -> DataFrame:
    """Writes the archives of pages to the shared folder, reads them back and returns what was read: page_id,
    payload_bytes, payload_digest, record_type, refers_to. Nulls, repeated rows and other columns as write() has them;
    an empty table gives no files and no rows. The archives stay until the result is read."""
    spark, kind = df.sparkSession, df.schema["page_id"].dataType
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(df, folder)
    return read(spark, folder).select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as h, min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes,
    array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1],
        lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * i + 1, 5))::bigint // k) % 32)::int, 1)), '')), '') as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id <> first then first end as refers_to
from s
"""
