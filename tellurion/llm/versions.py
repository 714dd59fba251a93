"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraphs: lines, cut behind sentence marks, and long ones without marks behind words that
their own hash picks, so that an edit moves no cut elsewhere. Each paragraph has a 64-bit digest, the k-th copy one of
its own. A sketch adds each digest to one cell in each of HASHES tables; a cell holds the number, the sum of digests and
the sum of check words. The sketch of CELLS cells is the fingerprint. Sketches of two versions subtract; what both hold
cancels out, and peeling cells that hold one digest recovers those that differ, with their side. If cells are left, both
are sketched again with GROWTH times as many cells. Likeness is the share of common paragraphs among all, exactly.

Scale: fingerprints are made in the scan. Comparing with the next document by doc_id deals texts out once, by ranges
whose first keys (one for each shuffle partition) go through the driver; a range's first row also goes to the range
before, so each task sees the next document of all its own. A task works on some MB of texts at a time, all sketches of
a slice in one array, so memory does not grow with a range, and copies of one text are not one task's matter beyond
their own range. Rows with equal doc_id follow one another by a hash of their text.

Defined cases: null text is empty and has no paragraphs; two empty texts have likeness 1, an empty and another 0; very
long texts count whole; equal rows are each other's next; a null doc_id comes first; the only row is its own next; the
caller's columns travel in a struct, and a caller's column with the name of a result gives way; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import mapped, others, packed, slices, table, unpacked

CELLS = 18
HASHES = 3
GROWTH = 4
#: A paragraph of more code points is cut behind words of which one in CUT_WORDS is picked.
LONG, CUT_WORDS = 400, 16
SLICE = 4 << 20

_PARAGRAPH = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+")
_CHECK = np.uint64(0x9E3779B97F4A7C15)


def paragraphs(text: str) -> list[str]:
    out = []
    for p in _PARAGRAPH.findall(text):
        if len(p) <= LONG:
            if p := p.strip():
                out.append(p)
            continue
        words, start = p.split(), 0
        for k, w in enumerate(words):
            if xxhash.xxh64_intdigest(w) % CUT_WORDS == 0 or k + 1 == len(words):
                out.append(" ".join(words[start : k + 1]))
                start = k + 1
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sets:
    """Paragraph digests of texts, number `of` the text each belongs to."""

    def __init__(self, texts: list[str]):
        found = [paragraphs(t) for t in texts]
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        of = np.repeat(np.arange(len(found)), self.sizes)
        plain = np.fromiter((xxhash.xxh64_intdigest(p) for ps in found for p in ps), np.uint64, len(of))
        order = np.lexsort((plain, of))
        of, plain = of[order], plain[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (plain[1:] != plain[:-1])
        copy = np.arange(len(of)) - np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
        self.of, self.digests = of, np.where(copy > 0, _mixed(plain + copy.astype(np.uint64)), plain)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def members(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in `numbers`, and digest, of all digests of these texts."""
        sizes = self.sizes[numbers]
        at = np.repeat(self.starts[numbers] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        return np.repeat(np.arange(len(numbers)), sizes), self.digests[at]


def cells(digests: np.ndarray, m: int) -> np.ndarray:
    """The cell of each digest in each table, one row a table."""
    each = np.uint64(m // HASHES)
    seeds = [np.uint64((m * int(_CHECK) + j + 1) % (1 << 64)) for j in range(HASHES)]
    return np.stack([(_mixed(digests + seed) % each).astype(np.int64) + j * (m // HASHES) for j, seed in enumerate(seeds)])


class Sketches:
    """`n` sketches of m cells each: numbers, sums of digests and of check words, modulo 2^64."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        self.count, self.key, self.check = np.zeros(n * m, np.int64), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint64)

    def add(self, of: np.ndarray, digests: np.ndarray, sign: np.ndarray) -> None:
        unsigned = sign.astype(np.uint64)  # -1 is 2^64 - 1
        key, check = digests * unsigned, _mixed(digests ^ _CHECK) * unsigned
        for at in cells(digests, self.m) + of * self.m:
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, key)
            np.add.at(self.check, at, check)

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes out what cells hold alone, again and again: sketch, digest, sign of all found, and which sketches are empty now."""
        found = []
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            sign = self.count[at]
            digest = self.key[at] * sign.astype(np.uint64)
            pure = self.check[at] == _mixed(digest ^ _CHECK) * sign.astype(np.uint64)
            at, digest, sign = at[pure], digest[pure], sign[pure]
            of = at // self.m
            order = np.lexsort((digest, of))
            of, digest, sign = of[order], digest[order], sign[order]
            first = np.ones(len(of), bool)  # a digest is alone in more than one of its cells
            first[1:] = (of[1:] != of[:-1]) | (digest[1:] != digest[:-1])
            of, digest, sign = of[first], digest[first], sign[first]
            found.append((of, digest, sign))
            self.add(of, digest, -sign)
            touched = np.unique(cells(digest, self.m) + of * self.m)
            at = touched[np.abs(self.count[touched]) == 1]
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        out = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.int64, np.uint64, np.int64))]
        return (*out, ~left.reshape(self.n, self.m).any(axis=1))

    def texts(self) -> list[str]:
        """Each sketch as text: 16 bytes a cell."""
        whole = np.zeros(self.n * self.m, [("n", "<i4"), ("key", "<u8"), ("check", "<u4")])
        whole["n"], whole["key"], whole["check"] = self.count, self.key, self.check & np.uint64(0xFFFFFFFF)
        data, size = whole.tobytes(), 16 * self.m
        return [base64.b64encode(data[k * size : (k + 1) * size]).decode() for k in range(self.n)]


def sketched(sets: Sets, numbers: np.ndarray, m: int = CELLS) -> Sketches:
    out = Sketches(len(numbers), m)
    of, digests = sets.members(numbers)
    out.add(of, digests, np.ones(len(of), np.int64))
    return out


def differences(sets: Sets, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair, digest, sign (1: in `old` only, -1: in `new` only) of all differing digests of the pairs, and the cells that each pair took."""
    m, left = CELLS, np.arange(len(old))
    taken, found = np.zeros(len(old), np.int64), []
    while len(left):
        # a sketch can't give back more digests than it has cells: those pairs wait for a larger one
        fit = np.abs(sets.sizes[old[left]] - sets.sizes[new[left]]) <= m
        now, waiting = left[fit], left[~fit]
        x = Sketches(len(now), m)
        for side, sign in ((old, 1), (new, -1)):
            of, digests = sets.members(side[now])
            x.add(of, digests, np.full(len(of), sign))
        of, digest, sign, done = x.peeled()
        ok = done[of] if len(of) else np.zeros(0, bool)
        found.append((now[of[ok]], digest[ok], sign[ok]))
        taken[now[done]] = m
        left, m = np.sort(np.concatenate([now[~done], waiting])), m * GROWTH
    return (*(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)), taken)


def likeness(sets: Sets, old: np.ndarray, new: np.ndarray, differing: np.ndarray) -> np.ndarray:
    both = sets.sizes[old] + sets.sizes[new]
    return np.where(both + differing > 0, (both - differing) / np.maximum(both + differing, 1), 1.0)


def _texts(column: pa.Array) -> list[str]:
    return [x.decode("utf-8", "surrogateescape") for x in column.to_pylist()]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def _binary() -> Column:
    return F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("text")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole, 1, SLICE)):
        texts = _safe(_texts(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sketched(Sets(texts), np.arange(len(texts))).texts())], names=["keep", "fingerprint"])


def _safe(texts: list[str]) -> list[str]:
    """Texts that can be hashed: bytes that are no UTF-8 become the replacement sign."""
    return [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with their fingerprint."""
    kept = others(docs.columns, ["fingerprint"])
    return unpacked(mapped(docs.select(packed(kept), _binary()), _fingerprints, "fingerprint string"), kept, "fingerprint")


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole, 1, SLICE)):
        n = b.num_rows
        sets = Sets(_safe(_texts(b.column(1)) + _texts(b.column(2))))
        old, new = np.arange(n), np.arange(n) + n
        pair, digest, sign, taken = differences(sets, old, new)
        sides = []
        for s in (1, -1):
            at = np.flatnonzero(sign == s)
            at = at[np.lexsort((digest[at], pair[at]))]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(pair[at], minlength=n))])
            sides.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(digest[at].view(np.int64))))
        like = likeness(sets, old, new, np.bincount(pair, minlength=n))
        yield pa.RecordBatch.from_arrays([b.column(0), *sides, pa.array(like), pa.array(taken, pa.int32())], names=["keep", "removed", "added", "likeness", "cells"])


def changes(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each key of both tables (unique in each): digests of paragraphs removed and added, likeness and the cells that it took."""
    both = old.select(F.col(key), _binary()).join(new.select(F.col(key), _binary().alias("other")), key)
    rows = both.select(packed([key]), "text", "other")
    return unpacked(mapped(rows, _changes, "removed array<bigint>, added array<bigint>, likeness double, cells int"), [key], "removed", "added", "likeness", "cells")


def ranges(keys: DataFrame) -> list:
    """The first (id, hash) of each range of about equally many rows, ascending: as many as shuffle partitions at most."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # with a number, small keys are not put together again
    found = keys.repartitionByRange(n, "id", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id", "h")).alias("first"))
    return [r.first for r in sorted(found.collect(), key=lambda r: r.p)]


def with_next(rows: DataFrame) -> DataFrame:
    """rows (keep, text, id), each range of them in its own order, with `look` for the row that only follows; part, look, keep, text."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    firsts = ranges(rows.select("id", "h"))
    if not firsts:
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("look"), "keep", "text")  # no row
    kind = rows.schema["id"].dataType
    bounds = [F.struct(F.lit(b[0]).cast(kind).alias("id"), F.lit(b[1]).cast("bigint").alias("h")) for b in firsts]
    key, step = F.struct("id", "h"), isqrt(len(bounds)) + 1
    block = F.size(F.filter(F.array(*bounds[::step]), lambda x: x <= key)) - 1
    inner = F.slice(F.array(*bounds), block * step + 1, F.lit(step))
    placed = rows.withColumn("part", block * step + F.size(F.filter(inner, lambda x: x <= key)) - 1)
    first = F.element_at(F.array(*bounds), F.col("part") + 1) == key
    own = F.struct(F.col("part"), F.lit(False).alias("look"))
    before = F.struct(((F.col("part") + len(bounds) - 1) % len(bounds)).alias("part"), F.lit(True).alias("look"))
    dealt = placed.withColumn("to", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select(F.struct("to.part", "to.look", "id", "h", "keep").alias("keep"), "text")
    dealt = mapped(dealt, _squeezed, "text binary").select("keep.*", "text").repartition("part")
    return dealt.sortWithinPartitions("part", "look", "id", "h").select("part", "look", "keep", "text")


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed: they are all that is shuffled."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in (part for whole in batches for part in slices(whole, 1, SLICE)):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(squeeze, b.column(1).to_pylist())), pa.binary())], names=["keep", "text"])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of each row with the row behind it in its range; the last of a slice waits for the next."""
    last: pa.RecordBatch | None = None
    restore = zstandard.ZstdDecompressor().decompress
    for b in (part for whole in batches for part in slices(whole, 3, SLICE // 3)):
        if last is not None:
            b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        last = b.slice(b.num_rows - 1)
        part, look = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(~look[:-1] & (part[:-1] == part[1:]))
        if not len(at):
            continue
        texts = [restore(x).decode("utf-8", "surrogateescape") for x in b.column(3).to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edited = [texts[k][: n - n // 2] + texts[k + 1][: n // 2] for k, n in zip(at.tolist(), sizes[at].tolist())]
        sets = Sets(_safe(texts + edited))
        new = np.arange(len(edited)) + len(texts)
        prints = sketched(sets, np.concatenate([at, new])).texts()
        old = np.concatenate([at, at])
        other = np.concatenate([new, at + 1])
        pair, _, _, _ = differences(sets, old, other)
        like = likeness(sets, old, other, np.bincount(pair, minlength=len(old)))
        digests = [hashlib.sha256(_bytes(t)).hexdigest() for t in edited]
        n = len(at)
        columns = [b.column(2).take(pa.array(at)), pa.array(sizes[at]), pa.array(digests), pa.array(prints[:n]), pa.array(prints[n:]), pa.array(like[:n]), pa.array(like[n:])]
        yield pa.RecordBatch.from_arrays(columns, names=["keep", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


BESIDE = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def beside_next(docs: DataFrame) -> DataFrame:
    """docs (their columns but the text) with the fingerprint of each text and of the text whose second half the next document's
    beginning replaces, and its likeness to that text and to the next document's."""
    own = [c.split()[0] for c in BESIDE.split(", ")]
    kept = others(docs.columns, [*own, "text"])
    rows = with_next(docs.select(packed(kept), _binary(), F.col("doc_id").alias("id")))
    found = rows.mapInArrow(_beside, StructType([StructField("keep", rows.schema["keep"].dataType), *StructType.fromDDL(BESIDE).fields]))
    return unpacked(found, kept, *own)


def op11_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """doc_id, n_chars, edited_sha256, near_edited, near_next by comparing the paragraphs themselves; doc_ids are unique."""
    from collections import Counter

    docs = sorted(((i, t or "") for i, t in docs), key=lambda x: (x[0] is not None, x[0] or 0))

    def near(a: str, b: str) -> float:
        x, y = Counter(paragraphs(a)), Counter(paragraphs(b))
        union = (x | y).total()
        return (x & y).total() / union if union else 1.0

    out = []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(text, edited), near(text, after)))
    return out
