"""Line dedup with two Bloom filters, one for hashes seen once and one for hashes seen twice.

Pass 1 fills both filters per partition and merges them by segment: a bit set by two partitions counts as set twice, so
the merged second filter has every line key of two or more documents and few others. Pass 2 asks it about each line;
only suspected repeats leave their task, as (128-bit key digest, doc_id). Exact counting by digest then confirms them
and picks the occurrence that stays; the line lists of the affected documents meet their texts in one join on doc_id.

Scale: the filters grow with the number of lines up to MAX_BITS_LOG2 (128 MB each), which also bounds what is
broadcast. Beyond that they let more single lines through to the exact stage: results stay the same, the shuffle grows
in proportion to the lines. Hot lines are counted with partial aggregation. A decision reaches the rows of its line by a
join on the digest; digests that hold more than 1 / HOT of all suspected rows (at most HOT of them, at any size) are
decided where their rows lie, by a broadcast, so that no task gets more of one line than that.

Defined cases: null or empty text is one empty line; a key counts once per doc_id however often it occurs; all rows
that share the largest doc_id keep their lines; rows with a null doc_id pass unchanged and are not counted; very long
texts and lines are hashed whole; repeated rows are one document to the counts and lose the same lines; columns kept are
carried as they are, but a caller's column with the name of a result gives way; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answer, batch, binary_text, mapped, others, packed, stored, table, unpacked

MIN_CHARS = 20
MIN_DOCS = 3
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bits of each filter: about BITS_PER_LINE a line, a power of two between these.
BITS_PER_LINE, MIN_BITS_LOG2, MAX_BITS_LOG2 = 12, 20, 30
SEGMENT_BYTES = 1 << 16
PROBES = 3
#: A line with more than 1 / HOT of all suspected rows is hot.
HOT = 1000


def key_of(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # bytes.lower() is A-Z only


def long_enough(key: bytes, min_chars: int = MIN_CHARS) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode()) >= min_chars)


def digests(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """A digest per line, None for lines too short to count."""
    return [xxhash.xxh3_128_digest(k) if long_enough(k := key_of(x), min_chars) else None for x in text.split(b"\n")]


def _bits(of: list[bytes], log2: int) -> np.ndarray:
    """PROBES bit positions for each digest, by double hashing."""
    h = np.frombuffer(b"".join(of), dtype="<u8").reshape(-1, 2)
    a, b = h[:, 0], h[:, 1] | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) >> np.uint64(64 - log2) for k in range(PROBES)], axis=1)


SEGMENT = pa.schema([("segment", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _add(once: np.ndarray, twice: np.ndarray, bits: np.ndarray) -> None:
    """bits: of distinct keys of one document. Keys whose bits were all set before are seen twice."""
    at, bit = bits >> np.uint64(3), (np.uint8(1) << (bits & np.uint64(7)).astype(np.uint8)).astype(np.uint8)
    seen = ((once[at] & bit) != 0).all(axis=1)
    np.bitwise_or.at(twice, at[seen].ravel(), bit[seen].ravel())
    np.bitwise_or.at(once, at.ravel(), bit.ravel())


def _fill(log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, twice = np.zeros(1 << (log2 - 3), np.uint8), np.zeros(1 << (log2 - 3), np.uint8)
        for b in batches:
            for text in b.column(0).to_pylist():
                if keys := {d for d in digests(text) if d}:
                    _add(once, twice, _bits(list(keys), log2))
        part = TaskContext.get().partitionId()
        step = min(SEGMENT_BYTES, len(once))
        for s in range(0, len(once), step):
            if (o := once[s : s + step]).any():
                yield batch(SEGMENT, [[s // step], [part], [zlib.compress(o.tobytes(), 1)], [zlib.compress(twice[s : s + step].tobytes(), 1)]])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one or more segments, in order of segment."""
    segment, once, twice = None, None, None

    def out(part: int = 0):
        return batch(SEGMENT, [[segment], [part], [zlib.compress(once.tobytes(), 1)], [zlib.compress(twice.tobytes(), 1)]])

    for b in batches:
        for s, part, o, t in zip(*(c.to_pylist() for c in b.columns)):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
            if segment is not None and (s, part) != (segment, held):
                yield out(held)
                segment = None
            if segment is None:
                segment, held, once, twice = s, part, o.copy(), t.copy()
            else:
                twice |= t | (once & o)
                once |= o
    if segment is not None:
        yield out(held)


def seen_twice(docs: DataFrame) -> tuple[int, np.ndarray]:
    """log2 of the filter's bits, and the filter of hashes of two or more documents. docs: column text in bytes."""
    lines = docs.agg(F.sum(F.lit(1) + F.length("text") - F.length(F.expr("translate(decode(text, 'UTF-8'), '\n', '')").cast("binary")))).first()[0] or 1
    log2 = int(min(MAX_BITS_LOG2, max(MIN_BITS_LOG2, np.ceil(np.log2(BITS_PER_LINE * lines)))))
    schema = "segment int, part int, once binary, twice binary"
    filled = docs.select("text").mapInArrow(_fill(log2), schema)
    # two levels, so that no task merges a segment over all partitions
    for width in (64, 1):
        by = F.pmod(F.col("part"), F.lit(width))
        filled = filled.withColumn("part", by).repartition("segment", "part").sortWithinPartitions("segment", "part").mapInArrow(_merge, schema)
    merged = np.zeros(1 << (log2 - 3), np.uint8)
    step = min(SEGMENT_BYTES, len(merged))
    for row in filled.select("segment", "twice").toLocalIterator():
        merged[row.segment * step : (row.segment + 1) * step] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return log2, merged


def _suspects(shared, log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            ids, out = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not (keys := list({d for d in digests(text) if d})):
                    continue
                bits = _bits(keys, log2)
                hit = ((twice[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
                found = [k for k, h in zip(keys, hit) if h]
                ids += [doc_id] * len(found)
                out += found
            yield batch(pa.schema([("doc_id", b.schema[0].type), ("digest", pa.binary())]), [ids, out])

    return run


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, digest) of the lines to drop: keys of min_docs documents or more, but in the largest doc_id."""
    spark = docs.sparkSession
    source = docs.where("doc_id is not null").select("doc_id", binary_text().alias("text"))
    kind = source.schema[0].dataType.simpleString()
    log2, twice = seen_twice(source)
    shared = spark.sparkContext.broadcast(twice.tobytes())
    suspects = stored(spark, source.mapInArrow(_suspects(shared, log2), f"doc_id {kind}, digest binary"), "line-suspects")
    # a repeated row must not count twice
    once = suspects.groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    counts = once.groupBy("digest").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    counts = stored(spark, counts.select("digest", "last", "rows"), "line-counts")
    limit = suspects.count() / HOT
    hot = counts.where(F.col("rows") > limit).select("digest", F.col("last").alias("hot"))
    marked = suspects.join(F.broadcast(hot), "digest", "left")
    rest = marked.where("hot is null").join(counts.where(F.col("rows") <= limit), "digest").where("doc_id <> last")
    return marked.where("doc_id <> hot").select("doc_id", "digest").unionByName(rest.select("doc_id", "digest"))


def _keep(text: bytes, drop: list[bytes]) -> list[bytes]:
    lines = text.split(b"\n")
    gone = set(drop)
    return [x for x, d in zip(lines, digests(text)) if d not in gone] if gone else lines


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """keep, text in bytes and digests to drop to keep, lines, lines dropped and the kept text."""
    for b in batches:
        n, gone, kept = [], [], []
        for text, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            left = _keep(text, drop or [])
            n.append(text.count(b"\n") + 1)
            gone.append(n[-1] - len(left))
            kept.append(b"\n".join(left))
        yield answer(b, _ld_lines=pa.array(n, pa.int64()), _ld_dropped=pa.array(gone, pa.int64()), _ld_text=pa.array(kept, pa.binary()).cast(pa.string()))


RESULTS = ("_ld_lines", "_ld_dropped", "_ld_text")


def _deduped(docs: DataFrame, min_docs: int, kept: list[str]) -> DataFrame:
    """keep and RESULTS."""
    drop = repeated_lines(docs, min_docs).groupBy("doc_id").agg(F.collect_set("digest").alias("drop")).withColumnRenamed("doc_id", "id")
    rows = docs.select(packed(kept), F.col("doc_id").alias("key"), binary_text().alias("text"))
    joined = rows.join(drop, F.col("key") == F.col("id"), "left").select("keep", "text", "drop")
    return mapped(joined, _rebuild, "_ld_lines bigint, _ld_dropped bigint, _ld_text string")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, then _ld_lines (before dropping), _ld_dropped and _ld_text (kept lines)."""
    kept = others(keep, RESULTS)
    return unpacked(_deduped(docs, min_docs, kept), kept, *RESULTS)


def clean_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with their repeated lines gone; other columns stay, n_chars follows the text. A document that loses all of
    its lines stays with an empty text."""
    rest = [c for c in docs.columns if c != "text"]
    found = _deduped(docs, min_docs, rest)
    new = {"text": F.col("_ld_text")}
    if "n_chars" in rest:
        new["n_chars"] = F.when(F.col("_ld_dropped") > 0, F.length("_ld_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("keep.n_chars"))
    return found.select(*(new.get(c, F.col(f"keep.`{c}`")).alias(c) for c in docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), F.sha2("_ld_text", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], min_docs: int = MIN_DOCS) -> list[tuple]:
    holders: dict[bytes, set] = {}
    for doc_id, text in docs:
        for line in (text or "").encode().split(b"\n"):
            if len((k := key_of(line)).decode()) >= MIN_CHARS:
                holders.setdefault(k, set()).add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").encode().split(b"\n")
        left = [x for x in lines if len(ids := holders.get(key_of(x), ())) < min_docs or max(ids) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(left), hashlib.sha256(b"\n".join(left)).hexdigest()))
    return out


SQL = r"""
WITH line AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
rep AS (SELECT key, max(doc_id) AS last FROM line WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
flag AS (SELECT line.*, rep.key IS NOT NULL AND line.doc_id <> rep.last AS gone FROM line LEFT JOIN rep ON line.key = rep.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flag GROUP BY doc_id
"""
