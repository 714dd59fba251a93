"""Spelling variants: words that one inserted, deleted or replaced code point makes of one another, by pivotal grams.

Bigrams are ordered by how few words hold them. A word's prefix is its three first bigrams of that order (with all their
positions); among any three there are two that do not overlap, and dynamic programming takes the two of least frequency
as pivots. One edit leaves one of two disjoint bigrams whole, so for two near words a pivot of that with the earlier
prefix end is in the other's prefix. Position limits: beside a bigram that is whole there is one edit, on one side of it
only. So a posting has the bigram's place from the start and everything up to it, or its place from the end and
everything behind it, as its key; pairs of a list are verified by edit distance.

Scale: entries are a few rows a word. In a list of up to LIST_PAIRS entries pivots meet prefixes. In a longer one every
entry emits its word and the words without one code point of the side that is still free, and pivots meet prefixes on
these: near words share one, and such a list holds at most alphabet x length words, so no crowded list is paired out.
Words too short for three bigrams or over LONG code points meet on hashes of the same variants. Bigram counts go through
the driver: their number is bounded by the square of the alphabet of the pattern (90 letters), not by the words.

Defined cases: null texts and words count as none; repeated words add their counts; words of any length are grouped;
equal counts choose the least word in code-point order; other columns are not looked at, so their names do not matter;
an empty table gives an empty result. A null doc_id is written as empty text where a run is hashed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, stored, table

#: A near word is a form where it occurs so many times as often.
RATIO = 10
MIN_CHARS = 7
MIN_COUNT = 2
#: Query: a run in so many loses a code point.
ONE_IN = 31
#: Bigrams of a prefix: two for each edit and one.
PREFIX = 3
LIST_PAIRS = 64
#: Words of SHORT to LONG + 1 code points go by pivots, those up to SHORT or from LONG on by variants: any pair meets in one.
SHORT, LONG = 4, 64

#: In place of a pivot's rank.
NO_PIVOT = (1 << 31) - 1

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c == 0xC3 for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def pivots(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """Positions of the two disjoint bigrams of least total frequency, of (position, frequency) in order of position."""
    best, one, k = None, None, 0  # one: the cheapest bigram that ends before the present one begins
    for p, cost in prefix:
        while prefix[k][0] + 2 <= p:
            one = min(one or (prefix[k][1], prefix[k][0]), (prefix[k][1], prefix[k][0]))
            k += 1
        if one:
            found = (one[0] + cost, one[1], p)
            best = min(best or found, found)
    return best[1], best[2]


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _running(codes: list[int]) -> list[int]:
    """Hashes of all beginnings, the empty one first."""
    out, h = [0], 0
    for c in codes:
        h = (h * _BASE + c + 1) % _PRIME
        out.append(h)
    return out


def entries(word: str, rank: dict[str, int], counts: dict[str, int]) -> list[tuple[int, int, int, int, int]]:
    """(key, free side from, to, rank of the prefix's last bigram, that rank again for a pivot and NO_PIVOT else) of each posting."""
    size = len(word)
    ranks = [rank[word[i : i + 2]] for i in range(size - 1)]
    order = sorted(range(size - 1), key=ranks.__getitem__)
    last = ranks[order[PREFIX - 1]]
    chosen = pivots([(i, counts[word[i : i + 2]]) for i in sorted(order[:PREFIX])])
    out = []
    for p in order:
        if ranks[p] > last:
            break
        pivot = last if p in chosen else NO_PIVOT
        out.append((_hash("^" + word[: p + 2]), p + 2, size, last, pivot))
        out.append((_hash("$" + word[p:]), 0, p, last, pivot))
    return out


def variants(word: str) -> set[int]:
    """Hashes of the word and of the word without each of its code points."""
    codes = list(map(ord, word))
    start, n = _running(codes), len(codes)
    out, power = {start[n]}, 1
    for i in range(n - 1, -1, -1):  # power: _BASE to the number of code points behind i
        out.add((start[i] * power + start[n] - start[i + 1] * power) % _PRIME)
        power = power * _BASE % _PRIME
    return out


def _posted(counts: dict[str, int]):
    rank = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                found = [entries(w, rank, counts) for w in b.column(0).to_pylist()]
                of = pa.array(np.repeat(np.arange(b.num_rows), list(map(len, found))))
                rest = np.array([e for f in found for e in f], np.int64).reshape(-1, 5)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                key, low, high, last, pivot = (pa.array(rest[:, k].astype(t.to_pandas_dtype())) for k, t in enumerate(kinds))
                yield pa.RecordBatch.from_arrays([key, b.column(0).take(of), b.column(1).take(of), low, high, last, pivot], names=["key", "word", "n", "low", "high", "last", "pivot"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Counter()
    for b in batches:
        for word in b.column(0).to_pylist():
            seen.update(map("".join, zip(word, word[1:])))
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])


def _varied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for word, id_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            keys = sorted(variants(word))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([id_] * len(keys), pa.string())], names=["key", "id"])


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """How often words hold each bigram: as many entries as pairs of letters at most."""
    found = words.select("word").mapInArrow(_grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in found.collect()}


def _one_edit(a: str, b: str) -> Column:
    return F.levenshtein(a, b, 1) == 1


def _between(x: DataFrame, on: str) -> DataFrame:
    """Near pairs of a pivot and a prefix bigram of x that share `on`. Both sides are asked for the same columns and no filter
    is of one side, so that Spark deals them out once and uses that twice."""
    x = x.select(on, "word", "n", "last", "pivot")
    both = x.alias("x").join(x.alias("y"), F.col(f"x.{on}") == F.col(f"y.{on}"))
    both = both.where("x.word < y.word and (x.pivot <= y.last or y.pivot <= x.last)").where(_one_edit("x.word", "y.word"))
    return both.select(F.col("x.word").alias("a"), F.col("x.n").alias("na"), F.col("y.word").alias("b"), F.col("y.n").alias("nb"))


def pivot_pairs(words: DataFrame) -> DataFrame:
    """Near pairs a, na, b, nb, in either order and perhaps repeated, of words of SHORT code points or more."""
    spark = words.sparkSession
    found = words.mapInArrow(_posted(bigram_counts(words)), "key bigint, word string, n bigint, low int, high int, last int, pivot int")
    posted = stored(spark, found, "spelling-entries")
    lists = posted.groupBy("key").agg(F.count("*").alias("size"), F.min("pivot").alias("some")).where((F.col("size") > 1) & (F.col("some") < NO_PIVOT)).select("key", "size")
    crowded = stored(spark, lists.where(F.col("size") > LIST_PAIRS).select("key"), "spelling-crowded")
    few = posted.join(lists.where(F.col("size") <= LIST_PAIRS).select("key"), "key")
    free = F.expr("if(high > low, transform(sequence(low, high - 1), i -> concat(substring(word, 1, i), substring(word, i + 2))), array())")
    shapes = F.explode(F.array_distinct(F.concat(F.array("word"), free)))
    many = posted.join(crowded, "key").select("key", "word", "n", "last", "pivot", shapes.alias("shape"))
    many = many.select(F.xxhash64("key", "shape").alias("shape"), "word", "n", "last", "pivot")
    return _between(few, "key").unionByName(_between(many, "shape"))


def variant_pairs(words: DataFrame) -> DataFrame:
    """Near pairs of words that pivots do not serve: very short and very long ones."""
    rows = words.withColumn("id", F.md5("word"))
    keys = rows.select("word", "id").mapInArrow(_varied, "key bigint, id string")
    pairs = keys.join(keys.toDF("key", "other"), "key").where("id < other").select("id", "other").distinct()
    a, b = rows.select("id", F.col("word").alias("a"), F.col("n").alias("na")), rows.select(F.col("id").alias("other"), F.col("word").alias("b"), F.col("n").alias("nb"))
    return pairs.join(a, "id").join(b, "other").where(_one_edit("a", "b")).select("a", "na", "b", "nb")


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair a < b of words (word, n; no word twice) that one edit makes of one another, once, with na and nb."""
    size = F.char_length("word")
    by_pivots = pivot_pairs(words.where((size >= SHORT) & (size <= LONG + 1)))
    by_variants = variant_pairs(words.where((size <= SHORT) | (size >= LONG)))
    x, y = F.struct(F.col("a").alias("w"), F.col("na").alias("n")), F.struct(F.col("b").alias("w"), F.col("nb").alias("n"))
    pairs = by_pivots.unionByName(by_variants).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()
    return pairs.select(F.col("x.w").alias("a"), F.col("x.n").alias("na"), F.col("y.w").alias("b"), F.col("y.n").alias("nb"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for rows word, form: the end of each chain. Counts grow along a chain, so it ends; rounds double its reach."""
    spark = forms.sparkSession
    now = stored(spark, forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(spark, now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = not after.where("moved").isEmpty()
        discard(now)
        now = stored(spark, after.select("word", "root"), "spelling-roots") if moved else after.select("word", "root")
        if not moved:
            return now
        discard(after)


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words (word, n) of a table."""
    spark = words.sparkSession
    words = words.where("word is not null and word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = stored(spark, words, "spelling-words")
    pairs = near_pairs(words)
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("nb").alias("m"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("na").alias("m"), F.col("a").alias("near")))).alias("e")).select("e.*")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("is", F.coalesce(-F.col("best.m") >= ratio * F.col("n"), F.lit(False)))
    found = found.select("word", F.when(F.col("is"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is"), -F.col("best.m")).alias("form_n"))
    found = stored(spark, found, "spelling-forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def letter_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: start, end and code points of each run of letters. À to ÿ are the byte C3 and a byte behind it."""
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _LETTER[data] | second, [False]]).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    behind = np.concatenate([[0], np.cumsum(second)])
    return start, end, end - start - (behind[end] - behind[start])


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] of each run, behind bytes whose CRC-32 is the run's state: a byte of all runs at a time."""
    out = state ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(start - end, kind="stable")  # the longest first, so that those with a k-th byte come first
    sizes, first, now = (end - start)[order], start[order], out[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))
        now[:n] = _CRC[(now[:n] ^ data[first[:n] + k]) & np.uint32(255)] ^ (now[:n] >> np.uint32(8))
    out[order] = now ^ np.uint32(0xFFFFFFFF)
    return out


def _counted(min_chars: int, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1, 16 << 20)):
            offsets = np.frombuffer(b.column(1).buffers()[1], np.int32, b.num_rows + 1, 4 * b.column(1).offset)
            whole = np.frombuffer(b.column(1).buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            # texts that touch must not share a run: a line feed goes between them
            data = _LOWER[np.insert(whole, offsets[1:-1], 10)] if b.num_rows > 1 else _LOWER[whole]
            offsets = offsets + np.arange(len(offsets))
            start, end, chars = letter_runs(data)
            kept = chars >= min_chars  # no run of fewer code points gives a word that counts
            start, end, chars = start[kept], end[kept], chars[kept]
            ids = np.array([zlib.crc32(f"{i}:".encode()) for i in b.column(0).to_pylist()], np.uint32)
            h = crcs(data, start, end, ids[np.searchsorted(offsets, start, "right") - 1])
            at = np.flatnonzero(h % one_in == 0)
            cut = [_without(data[s:e].tobytes().decode(), k) for s, e, k in zip(start[at].tolist(), end[at].tolist(), (h[at] % chars[at]).tolist())]
            rest = np.delete(np.arange(len(start)), at)
            bounds = np.stack([start[rest], end[rest]], 1).reshape(-1)
            ends = np.concatenate([bounds, [len(data)]]).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            words = pa.concat_arrays([pieces.take(pa.array(np.arange(0, len(ends) - 1, 2))), pa.array(cut, pa.string())])
            words = words.filter(pc.greater_equal(pc.utf8_length(words), min_chars)).value_counts()
            yield pa.RecordBatch.from_arrays([words.field(0), words.field(1)], names=["word", "n"])

    return run


def _without(word: str, k: int) -> str:
    return word[:k] + word[k + 1 :]


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """word, n of the runs of letters of whole texts, of which one in `one_in` loses a code point that its hash names."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = rows.mapInArrow(_counted(min_chars, one_in), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


def brute_force(counts: dict[str, int], ratio: int = RATIO) -> list[tuple]:
    """The rows of group_variants by comparing all words with one another."""

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    beside = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, found in beside.items():
        v = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = v if v is not None and counts[v] >= ratio * counts[w] else None

    def root(w: str) -> str:
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), n, len(beside[w]), counts.get(form[w])) for w, n in counts.items()]


def brute_counts(docs: list[tuple], min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> dict[str, int]:
    import re

    lower = str.maketrans(UPPER, LOWER)
    seen = Counter()
    for id_, text in docs:
        for run in re.findall(f"[{LETTERS}]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            k = h % len(run)
            seen[run[:k] + run[k + 1 :] if h % ONE_IN == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= min_chars and n >= min_count}


#: CRC-32 from its definition: a table of 256 remainders, then a byte at a time.
SQL = """
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hex AS (SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM run GROUP BY doc_id, run),
byte AS (SELECT run, n, list_transform(range(0, len(x) // 2), lambda i: (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) AS b FROM hex),
crc AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]))) AS h FROM byte, tab),
word AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM crc GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS (SELECT DISTINCT word, n, i, word[:i] || word[i + 2:] AS v FROM (SELECT *, unnest(range(0, length(word))) AS i FROM word)),
pair AS (SELECT x.word, y.word AS near, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.v = y.v AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN word y ON x.v = y.word UNION SELECT y.word, x.word, x.n FROM cut x JOIN word y ON x.v = y.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM pair GROUP BY word),
form AS (SELECT w.word, CASE WHEN m >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n FROM word w LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS at FROM form WHERE form IS NOT NULL UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON walk.at = form.word WHERE form.form IS NOT NULL),
last AS (SELECT walk.word, walk.at AS root FROM walk JOIN form ON walk.at = form.word WHERE form.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM form LEFT JOIN last USING (word)
"""
