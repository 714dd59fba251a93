"""Near-duplicates by Jaccard similarity of word shingles: the byte-position index of simhash over bytes of minima.

A text is the set of its five-word shingles, words as in simhash. Its fingerprint has POSITIONS bytes, one of each of as
many least hashes of the set, so that two texts agree in a byte as often as their sets are alike. As in simhash, postings
are intersected five positions at a time, pairs are tallied on their shared positional bytes, pairs with MIN_SHARED or
more stay, and these are verified on the whole sets at SIMILARITY or more, so no pair below it links. Before sets are
read, a pair must also agree in parities: a set has PARITY_BITS bits, each the parity of how many of its hashes fall
there, and as many bits as two sets differ in they differ in shingles at least. The bound is exact, so it takes away no pair
that would be verified; in a group of many copies just below the similarity it takes away most. Texts of similarity 0.8 share a list with probability 0.9996 and reach MIN_SHARED with 0.99999; more similar ones do so more surely.

Pairs come in two turns. First every member of a list is paired with CENTRES of its members, least by hashes of their own
that are the same in all lists, which connects what is tight. Then members of different components so far are paired: in
lists of up to LIST_PAIRS each with each. A longer list is split by the other long lists of its members, so that a list
of the next level shares SHARED further bytes; a pair of similarity 0.8 shares 6.5 lists on average, and two of them with
probability 0.996, three with 0.98. Lists whose members are all in one component are done. Only a list that is still long
after LEVELS levels, whose members share LEVELS x SHARED of their bytes, is paired with OWN_CENTRES of its own members.

Scale: texts with the same set collapse to one row first. Whole sets are read again only for texts with a list, which a
bit table of fixed size picks out. Tables that are no longer read are removed.

Defined cases: a text of fewer than five words is one shingle; null, empty and wordless texts are one group; very long
texts count with all of their shingles; repeated rows are alike; rows without a doc_id are left out; any other columns
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_text, discard, slices, stored
from .components import components

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
#: Bytes of a fingerprint, and those that one posting list shares.
POSITIONS, SHARED = 100, 5
MIN_SHARED = 62
PARITY_BITS = 1024
#: Sets of a list that are paired each with each: a bit count each, and a row only where parities allow the similarity.
LIST_PAIRS = 256
CENTRES = 3
LEVELS = 4
OWN_CENTRES = 4
#: Bits of the table that tells which documents' sets are read again.
FILTER_BITS = 1 << 24

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _RANDOM.integers(0, 2**63, POSITIONS, dtype=np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = text.translate(LOWER).split()
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    else:
        hashes = list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(shingle)))), repeat(SEED)))
    return np.unique(np.array(hashes, dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """POSITIONS bytes, SHARED of them in each long; a set without shingles has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(POSITIONS, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[k : k + 2048, None] ^ _FLIPS) * _FACTORS).min(axis=0), out=least)
    # the lowest byte of a least hash is as good as random
    return ((least & np.uint64(255)).reshape(-1, SHARED) << (np.arange(SHARED, dtype=np.uint64) * np.uint64(8))).sum(axis=1).astype(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits as longs: whether an odd number of hashes begins with the bit's number."""
    odd = np.bincount((hashes >> np.uint64(65 - PARITY_BITS.bit_length())).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole)):
        ids, sizes, keys, odd = [], [], [], []
        for text in b.column(1).to_pylist():
            found = shingles(text)
            ids.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            sizes.append(len(found))
            keys.append(minima(found))
            odd.append(parities(found))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), _longs(ids), pa.array(sizes, pa.int32()), pa.array(keys, longs), pa.array(odd, longs)], names=["doc_id", "set", "size", "bytes", "parity"])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole)):
        found = [shingles(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([_longs([xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found]), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["set", "items"])


def _longs(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))


def _centre(*seed) -> Column:
    """The member of a list that is least by a hash."""
    return F.min_by(F.struct("set", "size"), F.xxhash64("set", *(F.lit(s) if isinstance(s, int) else s for s in seed)))


def posting_lists(sets: DataFrame) -> DataFrame:
    """(set, size, n, centres) and the key (t, key) of the lists with more than one set. Most lists have one: they are left out
    by their counts, before centres are chosen."""
    spark = sets.sparkSession
    posted = sets.select("set", "size", F.posexplode("bytes").alias("t", "key"))
    several = posted.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(spark, posted.join(several, ["t", "key"]), "near-shared")
    centres = shared.groupBy("t", "key").agg(F.array_distinct(F.array(*map(_centre, range(CENTRES)))).alias("centres"))
    lists = stored(spark, shared.join(centres, ["t", "key"]), "near-lists")
    discard(shared)
    return lists


def split_lists(placed: DataFrame, parity: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of structs x and y, of different roots, from posting lists (t, key, set, size, root) and (set, parity), and the
    tables behind them. Parities join only the lists that are paired each with each."""
    spark = placed.sparkSession
    level = placed.select(F.xxhash64("t", "key").alias("list"), "t", "set", "size", "root")
    base, pairs, tables = None, None, []
    member, thin = F.struct("set", "size", "root", "parity"), lambda side: F.struct(f"{side}.set", f"{side}.size").alias(side)
    for depth in range(LEVELS):
        sizes = level.groupBy("list").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("list", "n")
        now = stored(spark, level.join(sizes, "list"), "near-level")
        tables.append(now)
        short = now.where(F.col("n") <= LIST_PAIRS).join(parity, "set").select("list", member.alias("x"))
        found = short.join(short.select("list", F.col("x").alias("y")), "list").where("x.set < y.set and x.root <> y.root").where(_may_reach("x", "y"))
        found = found.select(thin("x"), thin("y"))
        pairs = found if pairs is None else pairs.unionByName(found)
        long = now.where(F.col("n") > LIST_PAIRS).drop("n")
        if long.isEmpty():
            break
        if depth + 1 == LEVELS:
            own = long.groupBy("list").agg(F.array_distinct(F.array(*(_centre(CENTRES + s, F.col("list")) for s in range(OWN_CENTRES)))).alias("own"))
            roots = placed.select(F.col("set").alias("id"), F.col("root").alias("of")).distinct()
            far = long.join(own, "list").select(F.struct("set", "size", "root").alias("x"), F.explode("own").alias("c")).join(roots, F.expr("c.set = id"))
            pairs = pairs.unionByName(far.where("x.root <> of").select(thin("x"), F.struct("c.set", "c.size").alias("y")))
            break
        base = long if base is None else base
        further = base.select("set", F.col("t").alias("next"), F.col("list").alias("other"))
        level = long.join(further, "set").where("next > t").select(F.xxhash64("list", "other").alias("list"), F.col("next").alias("t"), "set", "size", "root")
    return pairs, tables


def _pairs(x: DataFrame) -> DataFrame:
    """Distinct pairs a < b of structs x and y whose sizes allow the similarity."""
    low, high = F.least("x", "y"), F.greatest("x", "y")
    fit = F.least("x.size", "y.size") >= SIMILARITY * F.greatest("x.size", "y.size")
    return x.where(F.col("x.set") != F.col("y.set")).where(fit).select(low["set"].alias("a"), high["set"].alias("b")).distinct()


def _shared(x: str, y: str) -> str:
    """Equal bytes of two lists of longs: a byte is zero where adding to its low bits and the byte itself leave its high bit unset."""
    low, high = sum(0x7F << 8 * k for k in range(SHARED)), sum(0x80 << 8 * k for k in range(SHARED))
    one = lambda k: f"bit_count(~(((({x}[{k}] ^ {y}[{k}]) & {low}L) + {low}L) | ({x}[{k}] ^ {y}[{k}])) & {high}L)"
    return " + ".join(one(k) for k in range(POSITIONS // SHARED))


def _may_reach(x: str, y: str) -> Column:
    """Whether sets with these sizes and parities can have the similarity."""
    apart = " + ".join(f"bit_count({x}.parity[{k}] ^ {y}.parity[{k}])" for k in range(PARITY_BITS // 64))
    # at similarity s, sets differ in (1 - s) / (1 + s) of their sizes' sum; a little more against rounding
    return F.expr(f"({apart}) * {1 + SIMILARITY} <= ({x}.size + {y}.size) * {1 - SIMILARITY} + 1e-6")


def counted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs that share MIN_SHARED positional bytes or more and whose parities allow the similarity."""
    side = lambda key, name: sets.select(F.col("set").alias(key), F.struct("size", "bytes", "parity").alias(name))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.where(F.expr(f"{_shared('x.bytes', 'y.bytes')} >= {MIN_SHARED}")).where(_may_reach("x", "y")).select("a", "b")


def verified(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Those of the pairs whose sets (columns set and items) have a Jaccard similarity of SIMILARITY or more."""
    both = pairs.join(items.toDF("a", "x"), "a").join(items.toDF("b", "y"), "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("both") >= SIMILARITY * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def _holders(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among ids, and a few more: a bit table of bounded size goes to the tasks."""
    h = lambda: F.xxhash64("doc_id").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = ids.select(F.shiftright(h(), 6).alias("word"), F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("held"))
    at = docs.withColumn("at", F.shiftright(h(), 6))
    return at.join(F.broadcast(words), F.col("at") == F.col("word")).where("shiftright(held, cast(xxhash64(doc_id) & 63 as int)) & 1 = 1").select(*docs.columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and _component, the least doc_id that the document reaches over links. Rows without a doc_id are left out."""
    spark = docs.sparkSession
    source = docs.where("doc_id is not null").select("doc_id", binary_text().alias("text"))
    kind = source.schema[0].dataType.simpleString()
    rows = stored(spark, source.mapInArrow(_keys, f"doc_id {kind}, set bigint, size int, bytes array<bigint>, parity array<bigint>"), "near-rows")
    sets = stored(spark, rows.groupBy("set").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "bytes", "parity"))), "near-sets")
    lists = posting_lists(sets.select("set", "size", "bytes"))
    member = F.struct("set", "size").alias("x")
    first = stored(spark, counted(_pairs(lists.select(member, F.explode("centres").alias("y"))), sets), "near-pairs")
    listed = lists.select("set").distinct()
    ids = sets.join(listed, "set").select(F.col("least").alias("doc_id"))
    found = _holders(source, ids).select("text").mapInArrow(_items, "set bigint, items array<bigint>")
    items = stored(spark, found.join(listed, "set", "left_semi").dropDuplicates(["set"]), "near-items")
    links = stored(spark, verified(first, items), "near-links")
    root = stored(spark, components(links), "near-roots")
    placed = lists.join(root.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    pairs, levels = split_lists(placed, sets.select("set", "parity"))
    more = verified(stored(spark, counted(_pairs(pairs), sets), "near-pairs"), items)
    edges = stored(spark, links.unionByName(more), "near-links")
    discard(lists, items, first, links, root, *levels)
    found = components(edges)
    all_sets = sets.select("set", "least")
    rooted = all_sets.join(found, all_sets["set"] == found["node"], "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("_component"))
    by_set = stored(spark, rooted.join(names, "root").select("set", "_component"), "near-components")
    discard(sets, edges)
    return rows.select("doc_id", "set").join(by_set, "set").select("doc_id", "_component")
