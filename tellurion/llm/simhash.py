"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most k bits agree in at least 8 - k of their 8 positional bytes. With k = 2
that guaranteed minimum is 6. An index on single (position, byte) pairs would put 1/256 of all rows in one posting
list, so postings are intersected five positions at a time: the 11 sets of FREE cover every way to keep 6 of 8 bytes,
and a posting list holds fingerprints that already share five positional bytes. Pairs from a list are tallied on all
eight positions, kept at the guaranteed minimum, and verified bit by bit.

Scale: exact copies collapse to one fingerprint first (partial aggregation), so a group of copies costs one row. A
posting list of up to LIST_PAIRS fingerprints is paired with itself. A longer one differs only in its 24 free bits, so
each member instead emits its 276 variants with two of them masked and is paired with the least member of each variant,
which pairs every two members within two bits with one and the same third. Either way the pairs go through the same
count filter and check and connect the same components, and neither emits all pairs of a large group.

Defined cases: null, empty or wordless text has fingerprint zero and links like any other; very long texts count all of
their shingles, repeats included; a bit set in just half of them is zero; repeated rows each get their row; rows with a
null doc_id get a fingerprint and join components but never name one unless all ids are null; columns kept are carried
as they are, but a caller's column with the name of a result gives way; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash
from .common import answer, binary_text, mapped, others, packed, slices, stored, table, unpacked
from .components import components
from .minhash import LOWER

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Fingerprints of a posting list that are paired directly.
LIST_PAIRS = 48

def _cover(size: int = 3, points: int = 8) -> list[tuple[int, ...]]:
    """Sets of `size` positions that together contain each pair of positions: greedy, few sets."""
    pairs = set(combinations(range(points), 2))
    out = []
    while pairs:
        best = max(combinations(range(points), size), key=lambda c: sum(p in pairs for p in combinations(c, 2)))
        out.append(best)
        pairs -= set(combinations(best, 2))
    return out


#: Left-out positions of each index; whichever two bytes differ, some index leaves both out.
FREE = _cover()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(shingle)))), repeat(SEED)))
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(bits), 255):  # sums of up to 255 ones fit a byte
        counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole)):
        yield answer(b, _fp=pa.array(np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and _fp, the fingerprint as a signed long."""
    kept = others(keep, ("_fp",))
    return unpacked(_with_fingerprint(docs, kept), kept, "_fp")


def _with_fingerprint(docs: DataFrame, kept: list[str]) -> DataFrame:
    return mapped(docs.select(packed(kept), binary_text().alias("text")), _fingerprints, "_fp bigint")


def _mask(free: tuple[int, ...]) -> int:
    """Ones over all positional bytes but the free ones, as a signed long."""
    m = sum(0xFF << (8 * p) for p in range(8) if p not in free)
    return m - (1 << 64) if m >> 63 else m


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(free: tuple[int, ...]) -> list[int]:
    bits = [8 * p + k for p in free for k in range(8)]
    return [_signed(~((1 << a) | (1 << b)) & (2**64 - 1)) for a, b in combinations(bits, 2)]


def _tally(a: str, b: str) -> str:
    return " + ".join(f"if((shiftright({a}, {8 * p}) & 255) = (shiftright({b}, {8 * p}) & 255), 1, 0)" for p in range(8))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, between distinct fingerprints (column _fp) that connect all pairs within MAX_BITS bits."""
    spark = fps.sparkSession
    masks = F.array(*(F.struct(F.lit(k).alias("t"), F.col("_fp").bitwiseAND(F.lit(_mask(f))).alias("key")) for k, f in enumerate(FREE)))
    posted = fps.select("_fp", F.explode(masks).alias("m")).select("_fp", "m.t", "m.key")
    sizes = posted.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    lists = stored(spark, posted.join(sizes, ["t", "key"]), "simhash-postings")
    short, long = lists.where(F.col("n") <= LIST_PAIRS), lists.where(F.col("n") > LIST_PAIRS)
    pairs = short.select("t", "key", F.col("_fp").alias("a")).join(short.select("t", "key", F.col("_fp").alias("b")), ["t", "key"]).select("a", "b")
    # of the free positions of a long list's pair, each choice of two bits is one variant
    tables = F.array(*(F.array(*(F.lit(v) for v in _variants(f))) for f in FREE))
    masked = long.select("_fp", "t", F.posexplode(F.element_at(tables, F.col("t") + 1)).alias("v", "mask"))
    masked = masked.select("_fp", "t", "v", F.col("_fp").bitwiseAND(F.col("mask")).alias("key"))
    least = masked.groupBy("t", "v", "key").agg(F.min("_fp").alias("a"), F.max("_fp").alias("z")).where("a < z")
    stars = masked.join(least.drop("z"), ["t", "v", "key"]).select("a", F.col("_fp").alias("b"))
    counted = pairs.unionByName(stars).where("a < b").where(F.expr(f"({_tally('a', 'b')}) >= {8 - MAX_BITS}"))
    return counted.where(F.expr(f"bit_count(a ^ b) <= {MAX_BITS}")).distinct()


def _classes(docs: DataFrame, kept: list[str]) -> DataFrame:
    """keep, _fp, _component."""
    spark = docs.sparkSession
    rows = stored(spark, _with_fingerprint(docs, list(dict.fromkeys((*kept, "doc_id")))), "simhash")
    fps = stored(spark, rows.groupBy("_fp").agg(F.min("keep.doc_id").alias("_least")), "simhash-distinct")
    found = components(links(fps.select("_fp")))
    rooted = fps.join(found, fps["_fp"] == found["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("_least").alias("_component"))
    by_fp = stored(spark, rooted.join(names, "root").select("_fp", "_component"), "simhash-components")
    return rows.join(by_fp, "_fp")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, _fp and _component: the least doc_id that the document reaches over links."""
    kept = others(keep, ("_fp", "_component"))
    return unpacked(_classes(docs, kept), kept, "_fp", "_component")


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each class (doc_id, _component) the document with the least doc_id; of several rows of that id the least by a hash
    of all columns (but maps, which Spark cannot hash). Rows without a doc_id cannot be told apart by it and stay."""
    keepers = classes.select(F.col("_component").alias("id")).distinct()
    rows = docs.select(packed(docs.columns), F.col("doc_id").alias("key"))
    chosen = rows.where("key is not null").join(keepers, F.col("key") == F.col("id"), "left_semi")
    row = F.xxhash64(*(F.col(f"keep.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    one = chosen.groupBy("key").agg(F.min_by("keep", row).alias("keep"))
    return unpacked(one.select("keep").unionByName(rows.where("key is null").select("keep")), docs.columns)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of fingerprints within MAX_BITS bits stays: see keep_one()."""
    return keep_one(docs, near_duplicates(docs.where("doc_id is not null")))


def drop_similar(docs: DataFrame) -> DataFrame:
    """One document of each group stays whose five-word shingles are alike to a Jaccard similarity of 0.8 or more: see
    keep_one(). At 0.8 SimHash fingerprints lie about 10 of 64 bits apart, where no number of shared bytes is sure, so
    the byte-position index holds bytes of minima here: see minhash."""
    return keep_one(docs, minhash.near_duplicates(docs))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """All pairs of fingerprints, for tests."""
    rows = []
    for doc_id, text in docs:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = [b" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, SEED) for g in grams]
        rows.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= MAX_BITS:
            parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(d, f"{fp:016x}", least[root(i)]) for i, (d, fp) in enumerate(rows)]
