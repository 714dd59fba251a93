"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Test items become sequences of word ids in one suffix automaton. Training documents stream through it word by
word while the length of the longest suffix that occurs in some item is tracked; wherever that length reaches the
window, the last `window` words are a passage of an item. Items shorter than a window match as a whole.

Scale: items are cut into blocks of at most `block_words` words, which are sent to the tasks one at a time, so what a
broadcast holds is bounded by that parameter and never by the size of the benchmark. Each worker builds an automaton
once. With one block documents are scanned without a shuffle. With several, each scan leaves only the numbers of rows
with hits and their spans, and these small rows meet the documents in one join.

Defined cases: null or empty text has no words and no hits; very long texts are scanned whole; repeated rows are each
scored; an item without words matches nothing; equal items, or one id with several texts, all count; items with a null id
are ignored; no other column of either table is looked at; columns kept are carried as they are, but a caller's column
with the name of a result gives way; empty tables of either kind give no hits.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answer, batch, binary_text, mapped, others, packed, slices, stored, table, unpacked

WINDOW = 10
#: Words of test items in one automaton (about 300 bytes a word in a task).
BLOCK_WORDS = 400_000

#: A-Z to a-z; letters, digits and all bytes of non-ASCII characters stay; everything else becomes a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word ids, with the items known at each state of window length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        paths = []
        for item_id, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last, path = 0, []
            for w in ids:
                last = self._extend(last, w)
                path.append(last)
            paths.append((item_id, ids, path))
        self._own(paths)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def _own(self, paths: list) -> None:
        """items_at: state of a window -> items that hold it. short_at: state -> whole short items that end there."""
        self.items_at: dict[int, set[str]] = {}
        self.short_at: dict[int, list[tuple[int, str]]] = {}
        n, link, length = self.window, self.link, self.length
        for item_id, ids, path in paths:
            if not ids:
                continue
            if len(ids) < n:
                state = 0
                for w in ids:
                    state = self.next[state][w]
                self.short_at.setdefault(state, []).append((len(ids), item_id))
                continue
            for state in path:
                while length[link[state]] >= n:
                    state = link[state]
                if length[state] >= n:
                    self.items_at.setdefault(state, set()).add(item_id)
        # the nearest state on the way to the root, itself included, at which a short item ends
        self.short_up = array("i", [-1]) * len(link)
        if self.short_at:
            for s in sorted(range(1, len(link)), key=length.__getitem__):
                self.short_up[s] = s if s in self.short_at else self.short_up[link[s]]

    def scan(self, words: list[bytes], longest: list | None = None) -> tuple[list[tuple[int, int]], set[str]]:
        """Half-open word spans under some window, merged, and the items that have a window here."""
        get, nxt, link, length, n = self.vocab.get, self.next, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        short_up = self.short_up if self.short_at else None
        state = matched = 0
        for i, word in enumerate(words):
            w = get(word)
            if w is None:
                state = matched = 0
                continue
            to = nxt[state].get(w)
            if to is None:
                while state and (to := nxt[state].get(w)) is None:
                    state = link[state]
                if to is None:
                    to = nxt[0].get(w)
                    matched = 0
                else:
                    matched = length[state]
            state, matched = to, matched + 1
            if matched >= n:
                at = state
                while length[link[at]] >= n:
                    at = link[at]
                found |= self.items_at.get(at, ())
                self._mark(spans, i + 1 - n, i + 1)
            if short_up is not None and (s := short_up[state]) >= 0:
                while s >= 0:
                    for m, item_id in self.short_at[s]:
                        if m <= matched:
                            found.add(item_id)
                            self._mark(spans, i + 1 - m, i + 1)
                    s = short_up[link[s]]
        return spans, found

    @staticmethod
    def _mark(spans: list, start: int, end: int) -> None:
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append((start, end))


class Block(list):
    """Items (id, text) of one automaton, which each worker builds once."""

    def automaton(self, window: int) -> Automaton:
        if getattr(self, "_window", None) != window:
            self._automaton, self._window = Automaton([(i, words_of(t)) for i, t in self], window), window
        return self._automaton


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items in blocks of a bounded number of words; one block at a time is held. At least one block, maybe empty."""
    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("i"), binary_text().alias("t"))
    block = Block()
    size = 0
    for row in rows.toLocalIterator():
        n = len(words_of(bytes(row.t)))
        if size and size + n > block_words:
            yield block
            block, size = Block(), 0
        block.append((row.i, bytes(row.t)))
        size += n
    yield block


def _found(b: pa.RecordBatch, results: list, clean: bool) -> pa.RecordBatch:
    """keep, text in bytes (the first two columns of b) and (words, spans, items) of each row to the columns of RESULTS."""
    own = {
        "n_words": pa.array([n for n, _, _ in results], pa.int64()),
        "starts": pa.array([[s for s, _ in spans] for _, spans, _ in results], pa.list_(pa.int64())),
        "ends": pa.array([[e for _, e in spans] for _, spans, _ in results], pa.list_(pa.int64())),
        "items": pa.array([sorted(items) for _, _, items in results], pa.list_(pa.string())),
    }
    if clean:
        texts = b.column(1)
        if any(spans for _, spans, _ in results):
            texts = pa.array([_without(t, spans) if spans else t for t, (_, spans, _) in zip(texts.to_pylist(), results)], pa.binary())
        own["clean"] = texts.cast(pa.string())
    return answer(b, **own)


def _scan(shared, window: int, clean: bool):
    """keep, text in bytes to the columns of RESULTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton(window)
        for b in (part for whole in batches for part in slices(whole)):
            words = (words_of(t or b"") for t in b.column(1).to_pylist())
            yield _found(b, [(len(w), *automaton.scan(w)) for w in words], clean)

    return run


def _hits(shared, window: int):
    """row, text in bytes to row, spans and items, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton(window)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans, items = automaton.scan(words_of(text or b""))
                if spans:
                    for column, value in zip(out, (row, [s for s, _ in spans], [e for _, e in spans], sorted(items))):
                        column.append(value)
            yield batch(HITS, out)

    return run


HITS = pa.schema([("row", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _merge(clean: bool):
    """keep, text in bytes, and lists of starts, ends and items by block to the columns of RESULTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            results = []
            for text, starts, ends, items in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                spans: list[tuple[int, int]] = []
                for s, e in sorted(zip((x for z in starts or () for x in z), (x for z in ends or () for x in z)), key=lambda x: (x[1], x[0])):
                    Automaton._mark(spans, s, e)
                results.append((len(words_of(text or b"")), spans, {x for z in items or () for x in z}))
            yield _found(b, results, clean)

    return run


RESULTS = ("n_words", "starts", "ends", "items")
DDL = "n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


def _passages(docs: DataFrame, items: DataFrame, window: int, block_words: int, kept: list[str], clean: bool) -> DataFrame:
    """keep, the columns RESULTS and, with clean, the text without its spans."""
    spark = docs.sparkSession
    source = docs.select(packed(kept), F.col("text").cast("binary").alias("text"))
    blocks = item_blocks(items, block_words)
    first, second = next(blocks), next(blocks, None)
    own = DDL + ", clean string" * clean
    if second is None:
        return mapped(source, _scan(spark.sparkContext.broadcast(first), window, clean), own)
    numbered = stored(spark, source.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    hits = []
    for block in chain((first, second), blocks):
        shared = spark.sparkContext.broadcast(block)
        hits.append(stored(spark, numbered.select("row", "text").mapInArrow(_hits(shared, window), "row bigint, starts array<bigint>, ends array<bigint>, items array<string>"), "decontaminate-hits"))
        shared.unpersist()
    merged = reduce(DataFrame.unionByName, hits).groupBy("row").agg(*(F.collect_list(c).alias(c) for c in RESULTS[1:]))
    joined = numbered.join(merged, "row", "left").select("keep", "text", *RESULTS[1:])
    return mapped(joined, _merge(clean), own)


def find_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ("doc_id",), clean: bool = False) -> DataFrame:
    """Columns `keep`, then n_words, starts, ends (merged word spans under windows) and items (ids with a window here);
    with clean also `clean`, the text without its spans."""
    own = (*RESULTS, *["clean"] * clean)
    kept = others(keep, own)
    return unpacked(_passages(docs, items, window, block_words, kept, clean), kept, *own)


def covered():
    return F.expr("aggregate(zip_with(starts, ends, (s, e) -> e - s), 0L, (a, x) -> a + x)")


def remove_passages(raw: bytes, starts: list[int], ends: list[int]) -> str:
    """The text without the characters from the first to the last word of each span."""
    return _without(raw, list(zip(starts, ends))).decode()


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    plain = raw.translate(WORD_BYTES)
    wanted = {s for s, _ in spans} | {e - 1 for _, e in spans}
    where: dict[int, tuple[int, int]] = {}
    pos = 0
    for k, w in enumerate(plain.split()):
        at = plain.index(w, pos)
        pos = at + len(w)
        if k in wanted:
            where[k] = (at, pos)
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : where[s][0]])
        last = where[e - 1][1]
    return b"".join([*out, raw[last:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the spans found in test items; a document of which they cover over max_coverage goes whole.

    Every column of docs is kept; n_chars, where present, follows the new text.
    """
    rest = [c for c in docs.columns if c != "text"]
    found = _passages(docs, items, window, block_words, rest, True).where(covered() <= max_coverage * F.col("n_words"))
    new = {"text": F.col("clean")}
    if "n_chars" in rest:
        new["n_chars"] = F.when(F.size("starts") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("keep.n_chars"))
    return found.select(*(new.get(c, F.col(f"keep.`{c}`")).alias(c) for c in docs.columns))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract read literally, for tests."""
    grams: dict[tuple, set[str]] = {}
    for item_id, text in items:
        w = words_of((text or "").encode())
        for k in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[k : k + window]), set()).add(str(item_id))
    sizes = {len(g) for g in grams}
    out = []
    for doc_id, text in docs:
        w = words_of((text or "").encode())
        hit: set[int] = set()
        ids: set[str] = set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in grams:
                    hit |= set(range(k, k + m))
                    ids |= grams[g]
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


SQL = r"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[k:k + 9] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM item WHERE len(w) >= 10)
  UNION SELECT item_id, w FROM item WHERE len(w) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT len(g) AS m FROM win),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT d.doc_id, d.k, d.m, win.item_id FROM (SELECT doc_id, m, w, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS k FROM doc, sizes WHERE len(w) >= m) d JOIN win ON win.g = d.w[d.k:d.k + d.m - 1]),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
