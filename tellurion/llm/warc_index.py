"""WARC archives with a two-level capture index.

Records are written as one gzip member each, one archive per task, under names of their own, so that a task that runs
again leaves no half-written file in use. Captures sort by reversed-host URL key into blocks of BLOCK_LINES lines,
compressed one by one. Each range of keys is one index file: its blocks, then a sparse directory with the first key of
each block. A look-up goes from the list of ranges (one row a file) to a range's directory, binary-searches it for the
block, range-reads and searches the block, and range-reads the record.

Scale: keys end in the record's id, so no URL or host fills one range. Equal payloads are found by digest with partial
aggregation; only the digests of repeated payloads meet the records again, in a join that Spark splits where one payload
is in very many records. Look-ups are range-partitioned like the index, so each task reads a block once; their number of
tasks is the session's number of shuffle partitions, as a key of a few bytes costs a range read. Besides the list of
ranges nothing is held whole. Archives go through pyarrow's file systems to any store it knows (file, hdfs, s3, gs).

Defined cases: a null payload is empty, a null URL has the empty key; records with the same id and payload are both
responses; a null id never is the record that others refer to unless all have none; repeated rows are records of their
own; very long payloads are one record each; URLs that are equal differ by the record's id; no other column is looked at,
whatever its name; the tables have no capture date, so that of all records is fixed; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, binary_text, shared_dir, table

BLOCK_LINES = 1000
MIN_DEDUP_BYTES = 0


def surt(url: str | None) -> str:
    """com,example)/path?query: host reversed and lowered, default port, scheme, user and fragment dropped."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url
    if not host:
        return url
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{name}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def key_of(url: str | None, id_: object) -> str:
    """No blank and no control character within, so that lines and order are safe."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", surt(url)) + " " + ("" if id_ is None else f"{id_:020d}" if isinstance(id_, int) else str(id_))


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(text: object) -> bytes:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", str(text)).encode()


#: The pages have no capture date.
DATE = b"1970-01-01T00:00:00Z"


def record_urn(id_: object, url: str | None) -> bytes:
    return b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"{id_} {url}")).encode()


def record(id_: object, url: str | None, payload: bytes, refers_to: object = None, refers_url: str | None = None) -> bytes:
    """One WARC record; a revisit names the record that it refers to and its URL, and keeps the HTTP header, which says how
    long the payload was, and not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + record_urn(id_, url),
        b"WARC-Date: " + DATE, b"WARC-Target-URI: " + _header(url or ""), b"WARC-Payload-Digest: sha1:" + digest32(payload).encode(), b"X-Record-Number: " + _header("" if id_ is None else id_),
    ]
    if refers_to is not None:
        lines += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_urn(refers_to, refers_url),
            b"WARC-Refers-To-Target-URI: " + _header(refers_url or ""), b"WARC-Refers-To-Date: " + DATE, b"X-Refers-To-Number: " + _header(refers_to),
        ]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record with which an archive begins."""
    block = b"software: tellurion\r\nformat: WARC File Format 1.1\r\n"
    lines = [b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: " + record_urn("", name), b"WARC-Date: " + DATE, b"WARC-Filename: " + name.encode(), b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member."""
    pack = zlib.compressobj(6, wbits=31)
    return pack.compress(raw) + pack.flush()


def parse(raw: bytes) -> dict:
    """Header fields by lower-case name, and the payload; a response whose payload does not match its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in head.split(b"\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload_bytes"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["warc-type"] == "response" and (len(payload) != fields["payload_bytes"] or fields["warc-payload-digest"] != "sha1:" + digest32(payload)):
        raise ValueError("payload does not match its record")
    return fields | {"payload": payload}


def with_originals(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int, url_col: str = "url") -> DataFrame:
    """The columns with id and URL, _payload, and _first and _first_url: the least id with an equal payload where that is
    another record, and its URL."""
    kept = list(dict.fromkeys((id_col, url_col)))
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), binary_text(payload_col).alias("_payload")).withColumn("_digest", F.unhex(F.sha1("_payload")))
    first = F.min(F.when(F.col(f"`{id_col}`").isNotNull(), F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))))
    groups = rows.groupBy("_digest").agg(first.alias("_least"), F.count("*").alias("_n")).where("_n > 1").select("_digest", "_least")
    joined = rows.join(groups, "_digest", "left")
    again = (F.length("_payload") >= min_bytes) & (F.col("_least.id").isNotNull()) & (F.col(f"`{id_col}`").isNull() | (F.col(f"`{id_col}`") != F.col("_least.id")))
    return joined.select(*(F.col(f"`{c}`") for c in kept), "_payload", F.when(again, F.col("_least.id")).alias("_first"), F.when(again, F.col("_least.url")).alias("_first_url"))


ENTRY = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _write(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, root = store(out)
        sink, name, offset = None, f"{uuid.uuid4().hex}.warc.gz", 0
        for b in batches:
            rows = []
            for id_, url, payload, first, first_url in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    store_.create_dir(root, recursive=True)
                    sink = store_.open_output_stream(f"{root}/{name}", compression=None)
                    sink.write(head := member(info(name)))
                    offset = len(head)
                sink.write(packed := member(record(id_, url, payload, first, first_url)))
                rows.append((key_of(url, id_), name, offset, len(packed)))
                offset += len(packed)
            yield batch(ENTRY, list(zip(*rows)) or [[], [], [], []])
        if sink is not None:
            sink.close()

    return run


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """A record per row in archives below `out`; returns the captures (key, file, offset, length), stored once."""
    rows = with_originals(pages, id_col, payload_col, min_bytes, url_col).select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), "_payload", "_first", "_first_url")
    rows.mapInArrow(_write(f"{out}/archive"), "key string, file string, offset bigint, length bigint").write.parquet(f"{out}/captures")
    return pages.sparkSession.read.parquet(f"{out}/captures")


RANGE = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def _index(out: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, root = store(out)
        sink, name, at = None, f"{uuid.uuid4().hex}.idx", 0
        directory: list[tuple[str, int, int]] = []
        held: list[tuple] = []
        last = ""

        def flush():
            nonlocal at
            block = zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode())
            directory.append((held[0][0], at, len(block)))
            sink.write(block)
            at += len(block)
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    store_.create_dir(root, recursive=True)
                    sink = store_.open_output_stream(f"{root}/{name}", compression=None)
                held.append(row)
                last = row[0]
                if len(held) >= block_lines:
                    flush()
        if sink is None:
            return
        if held:
            flush()
        packed = zlib.compress(json.dumps(directory).encode())
        sink.write(packed)
        sink.close()
        yield batch(RANGE, [[directory[0][0]], [last], [name], [at], [len(packed)]])

    return run


def build_index(captures: DataFrame, out: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Index files below `out`; returns their ranges of keys, one row a file."""
    rows = captures.select("key", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    schema = "first_key string, last_key string, file string, at bigint, size bigint"
    rows.mapInArrow(_index(f"{out}/index", block_lines), schema).write.parquet(f"{out}/ranges")
    return captures.sparkSession.read.parquet(f"{out}/ranges")


class Index:
    """Look-ups of one task. Keeps one open range, its directory, and the last block: keys come in order."""

    def __init__(self, out: str, ranges: list[tuple]):
        self.store, self.root = store(out)
        self.ranges = ranges
        self.lasts = [r[1] for r in ranges]
        self.range = self.block_at = None
        self.archives: dict[str, object] = {}
        self.blocks_read = 0

    def _open(self, k: int) -> None:
        _, _, name, at, size = self.ranges[k]
        self.file = self.store.open_input_file(f"{self.root}/index/{name}")
        self.file.seek(at)
        self.directory = json.loads(zlib.decompress(self.file.read(size)))
        self.firsts = [d[0] for d in self.directory]
        self.range, self.block_at = k, None

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of each capture of this key; equal keys may span blocks and ranges."""
        k = bisect_left(self.lasts, key)
        while k < len(self.ranges) and self.ranges[k][0] <= key:
            if self.range != k:
                self._open(k)
            # equal keys may begin in the block before the first whose first key is not below
            d = max(0, bisect_left(self.firsts, key) - 1)
            while d < len(self.firsts) and self.firsts[d] <= key:
                if self.block_at != d:
                    _, at, size = self.directory[d]
                    self.file.seek(at)
                    self.lines = [x.split("\t") for x in zlib.decompress(self.file.read(size)).decode().split("\n")]
                    self.keys = [x[0] for x in self.lines]
                    self.block_at = d
                    self.blocks_read += 1
                for x in self.lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]:
                    yield x[1], int(x[2]), int(x[3])
                d += 1
            k += 1

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.archives:
            if len(self.archives) >= 64:
                self.archives.pop(next(iter(self.archives))).close()
            self.archives[name] = self.store.open_input_file(f"{self.root}/archive/{name}")
        f = self.archives[name]
        f.seek(offset)
        return zlib.decompress(f.read(length), wbits=31)


FOUND = pa.schema([("key", pa.string()), ("url", pa.string()), ("number", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def _look_up(out: str, ranges: list[tuple], payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(out, ranges)
        for b in batches:
            rows = []
            for key in b.column(0).to_pylist():
                for at in index.find(key):
                    r = parse(index.read(*at))
                    rows.append((key, r["warc-target-uri"], r["x-record-number"], r["payload_bytes"], r["warc-payload-digest"][5:], r["warc-type"], r.get("x-refers-to-number"), r["payload"] if payload and r["warc-type"] == "response" else None))
            yield batch(FOUND, list(zip(*rows)) or [[]] * len(FOUND))

    return run


def look_up(keys: DataFrame, ranges: DataFrame, out: str, payload: bool = True) -> DataFrame:
    """The records of a column `key`, each distinct key once: number, URL, lengths, digests, types and payloads."""
    held = [tuple(r) for r in ranges.orderBy("first_key").collect()]  # one row for each index file
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = keys.select("key").distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return asked.mapInArrow(_look_up(out, held, payload), "key string, url string, number string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch(pa.schema([("key", pa.string())]), [[key_of(u, i) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]])


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = shared_dir(spark, "warc")
    ranges = build_index(write_archives(pages, out), out)
    keys = pages.select("page_id", "url").mapInArrow(_keys, "key string")
    found = look_up(keys, ranges, out, payload=False)
    return found.select(F.expr("try_cast(number as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def brute_force(pages: list[tuple]) -> list[tuple]:
    """(page_id, url, html) rows to the contract's rows."""
    first: dict[bytes, int] = {}
    for page_id, _, html in pages:
        p = (html or "").encode()
        first[p] = min(page_id, first.get(p, page_id))
    out = []
    for page_id, _, html in pages:
        p = (html or "").encode()
        again = first[p] != page_id
        out.append((page_id, len(p), digest32(p), "revisit" if again else "response", first[p] if again else None))
    return out
