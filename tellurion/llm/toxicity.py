"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are words and five-letter word beginnings; every term of a text counts. A term's weight in a text is
(1 + ln count) x idf x relevance: idf comes from the document frequencies of all documents, and relevance is how far the
examples that hold the term lean to either label, drawn to none by PRIOR examples of the base rate, plus FLOOR. A term
that no example holds cannot add to a cosine; it counts in the text's norm, with the greatest idf and FLOOR. Each text
becomes a unit vector, and its K nearest examples are found exactly: lists of terms of many examples know their greatest
weight in each block of examples, and only examples that can still reach the top K by these bounds are added up further. Votes are weighted by 1 / (distance + SOFT), calibrated by a logistic fit on leave-one-out
votes of the examples, and the examples with their similarities are the evidence.

Scale: labelled rows are a sample of about MAX_EXAMPLES (the one bound, by hash of the id, label shares as they are);
only it is sent to the tasks, as numbers. All documents are cut into terms once; their counts are stored, document
frequencies are added up from them by Spark, and scores are computed from them, without shuffling text.

Defined cases: null or empty text has no terms; a text without any term of an example gets the rate of such examples and
no evidence; very long texts are cut into terms as a whole; several labels of a document count as the greatest, of
several texts under one labelled doc_id the least (as a string) is the example; null labels and labels without a doc_id
are ignored; without any toxic example all scores are 0; examples as near as the K-th share its
vote, whatever their ids (of these the evidence names the least); repeated rows score alike; columns
kept are carried as they are, but a caller's column with the name of a result gives way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answer, mapped, others, packed, slices, stored, table, unpacked

MAX_EXAMPLES = 2_000
BEGINNING = 5
PRIOR = 5.0
FLOOR = 0.1
K = 15
SOFT = 0.05
BLOCK = 64
#: Lists of terms of more than this share of the examples are added up in steps, under bounds by block.
LONG_LIST = 1 / 16
#: Words whose numbers a worker keeps.
CACHE = 150_000

#: Letters and digits.
WORD = re.compile(r"[^\W_]+")


def term_counts(text: str | None) -> Counter:
    """Terms of one text, for tests: batches go through BatchTerms."""
    words = WORD.findall((text or "").lower())
    return Counter(words) + Counter([w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING])


class BatchTerms:
    """Terms of a batch of texts: distinct words and beginnings of longer words, and how often each text has them.

    rows, terms, counts: one entry for each text and term of its, in order of the text; terms are places in `names`.
    """

    def __init__(self, texts: pa.Array):
        words = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+")
        coded = words.flatten().dictionary_encode()
        self.names = coded.dictionary
        full = pc.not_equal(self.names, "").to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        at = coded.indices.to_numpy()
        key, n = np.unique((rows << 32 | at)[full[at]] if len(at) else np.zeros(0, np.int64), return_counts=True)
        longer = pc.greater(pc.utf8_length(self.names), BEGINNING).to_numpy(zero_copy_only=False)
        begun = pc.utf8_slice_codeunits(self.names, 0, BEGINNING).dictionary_encode()
        self.beginnings = begun.dictionary
        rows, at = key >> 32, key & 0xFFFFFFFF
        some = longer[at]
        more, back = np.unique(rows[some] << 32 | begun.indices.to_numpy()[at[some]], return_inverse=True)
        self.rows = np.concatenate([rows, more >> 32])
        self.terms = np.concatenate([at, len(self.names) + (more & 0xFFFFFFFF)])
        self.counts = np.concatenate([n, np.bincount(back, n[some], len(more)).astype(np.int64)])
        order = np.argsort(self.rows, kind="stable")
        self.rows, self.terms, self.counts = self.rows[order], self.terms[order], self.counts[order]

    def named(self, of) -> np.ndarray:
        """of(names, mark) for the words and then for the beginnings, which are marked by a star."""
        return np.concatenate([of(x.to_numpy(zero_copy_only=False).tolist(), mark) for x, mark in ((self.names, ""), (self.beginnings, "*"))])


def term_key(term: str) -> int:
    """Terms go by 63 bits of a hash."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) >> 1


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def labelled(labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, toxic) of about max_examples labelled rows outside fold 0."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = rows.count()
    if n <= max_examples:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_examples / n))


def _lists(rows: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    """Values, which lie in order of their rows, as a list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32()), pa.array(values))


def _keys(names: list[str], mark: str) -> np.ndarray:
    return np.fromiter((term_key(x + mark) for x in names), np.int64, len(names))


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic, text to doc_id, toxic, keys and counts, in order of the keys."""
    for b in (part for whole in batches for part in slices(whole)):
        found = BatchTerms(b.column(2))
        keys = found.named(_keys)[found.terms]
        order = np.lexsort((keys, found.rows))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), _lists(found.rows, b.num_rows, keys[order]), _lists(found.rows, b.num_rows, found.counts[order].astype(np.int32))], names=["doc_id", "toxic", "keys", "counts"]
        )


class Numbering:
    """Numbers of the terms that examples hold, by binary search in their sorted keys; a worker keeps those of words met."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.cache: dict[str, dict[str, int]] = {"": {}, "*": {}}

    def of(self, names: list[str], mark: str = "") -> np.ndarray:
        """-1 for terms of no example. mark: what stands behind the names."""
        cache = self.cache[mark]
        found = np.fromiter(map(cache.get, names, repeat(-2)), np.int64, len(names))
        new = np.flatnonzero(found == -2)
        if len(new):
            names = [names[k] for k in new.tolist()]
            keys = _keys(names, mark)
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            at = np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)
            found[new] = at
            if len(cache) > CACHE:
                cache.clear()
            cache.update(zip(names, at.tolist()))
        return found


@lru_cache(maxsize=2)
def _numbering(raw: bytes) -> Numbering:
    return Numbering(np.frombuffer(raw, np.int64))


def _counter(shared):
    """keep, text to keep, numbers and counts of the terms that examples hold, and the others' part of the squared norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = _numbering(shared.value)
        for b in (part for whole in batches for part in slices(whole)):
            found = BatchTerms(b.column(1))
            ids = found.named(numbering.of)[found.terms]
            known = ids >= 0
            rest = np.bincount(found.rows[~known], (1 + np.log(found.counts[~known])) ** 2, b.num_rows)
            rows, ids, n = found.rows[known], ids[known], found.counts[known]
            order = np.argsort(rows << 32 | ids)
            yield answer(b, terms=_lists(rows, b.num_rows, ids[order].astype(np.int32)), counts=_lists(rows, b.num_rows, n[order].astype(np.int32)), rest=pa.array(rest, pa.float64()))

    return run


class BlockMaxIndex:
    """Unit vectors of examples in blocks of similar ones; exact top-k by cosine.

    ptr, terms, weights: the vectors one after the other. Lists of terms of few examples are added up at once. Lists of
    many examples follow by their greatest effect, by STEPS; after each step only examples stay that can reach the
    top k by what the greatest weights in their block of the lists still to come allow. What is left is added up anew,
    in full and in double precision.
    """

    STEPS = (6, 16, 40, 80, 160, 320, 640)
    #: Sums before the last are in single precision.
    SLACK = 1e-4

    def __init__(self, ptr: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int = BLOCK, long_list: float = LONG_LIST):
        n = self.n = len(ptr) - 1
        rows = np.repeat(np.arange(n), np.diff(ptr))
        # examples with the same strongest term lie side by side
        lead = np.full(n, -1, np.int64)
        strongest = np.lexsort((-terms, weights, rows))
        lead[rows[strongest]] = terms[strongest]
        self.order = np.lexsort((np.arange(n), lead))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        rows = place[rows]
        self.vectors = ptr, terms, weights
        self.block_of = np.arange(n) // block
        sizes = np.bincount(terms, minlength=n_terms)
        is_long = sizes > max(long_list * n, 4)
        self.long = np.full(n_terms, -1, np.int32)
        self.long[is_long] = np.arange(is_long.sum())
        short = ~is_long[terms]
        by_term = np.lexsort((rows[short], terms[short]))
        self.rows, self.weights = rows[short][by_term], weights[short][by_term]
        self.ptr = np.concatenate([[0], np.cumsum(np.where(is_long, 0, sizes))])
        self.lists = np.zeros((int(is_long.sum()), n), np.float32)
        self.lists[self.long[terms[~short]], rows[~short]] = weights[~short]
        self.maxima = np.maximum.reduceat(self.lists, np.arange(0, n, block), axis=1) if n else self.lists
        self.query = np.zeros(n_terms)
        self.added = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, example), best first, of examples with a cosine above zero: k of them, and all others as near as the k-th."""
        at = self.long[terms]
        few = at < 0
        starts = self.ptr[terms[few]]
        sizes = self.ptr[terms[few] + 1] - starts
        pick = np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        score = np.bincount(self.rows[pick], self.weights[pick] * np.repeat(weights[few], sizes), minlength=self.n).astype(np.float32)
        if without >= 0:
            score[np.flatnonzero(self.order == without)] = -np.inf
        w, lists = weights[~few].astype(np.float32), at[~few]
        effect = w[:, None] * self.maxima[lists]
        order = np.argsort(-effect.max(axis=1, initial=0))
        w, lists, effect = w[order], lists[order], effect[order]
        # what the lists from each step on can still add, by block
        steps = [0, *(s for s in self.STEPS if s < len(w)), *range(2 * self.STEPS[-1], len(w), self.STEPS[-1])] if len(w) else []
        to_come = np.cumsum(np.add.reduceat(effect, steps, axis=0)[::-1], axis=0)[::-1] if len(w) else effect
        reach = None
        for j, s in enumerate(steps):
            step = slice(s, steps[j + 1] if j + 1 < len(steps) else None)
            some = lists[step]
            if reach is None:
                score += w[step] @ self.lists[some]
            else:
                score += w[step] @ self.lists[some[:, None], reach]
            if j + 1 == len(steps):
                break
            if len(score) > 2 * k:
                least = np.partition(score, len(score) - k)[len(score) - k] - self.SLACK
                blocks = self.block_of if reach is None else self.block_of[reach]
                stay = np.flatnonzero(score + to_come[j + 1][blocks] >= least)
                reach = stay if reach is None else reach[stay]
                score = score[stay]
        if reach is None:
            reach = np.arange(self.n)
        if len(score) > k:
            stay = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - self.SLACK)
            reach, score = reach[stay], score[stay]
        chosen = self.order[reach[score > 0]]
        self.added += len(chosen)
        ptr, all_terms, all_weights = self.vectors
        self.query[terms] = weights
        found = []
        for i in chosen.tolist():
            part = slice(ptr[i], ptr[i + 1])
            found.append((-round(float(self.query[all_terms[part]] @ all_weights[part]), 12), i))
        self.query[terms] = 0
        found = sorted(x for x in found if x[0] < 0)
        return [(-s, i) for s, i in found if len(found) <= k or s <= found[k - 1][0]]


def shares(sims: np.ndarray, k: int = K) -> np.ndarray:
    """How much of a vote each of the nearest has, best first: those as near as the k-th share the places that are left."""
    out = np.ones(len(sims))
    if len(sims) > k:
        tied = sims == sims[k - 1]
        out[tied] = (k - np.sum(sims > sims[k - 1])) / tied.sum()
    return out


def vote(found: list[tuple[float, int]], toxic: np.ndarray, base: float) -> float:
    """Distance-weighted share of toxic examples, drawn to the base rate by the weight of one far example."""
    if not found:
        return base
    sims = np.array([s for s, _ in found])
    weights = shares(sims) / (1 - sims + SOFT)
    marks = toxic[[i for _, i in found]]
    order = np.lexsort((marks, -sims))  # sums do not depend on the examples' numbers
    return float((weights[order] @ marks[order] + base) / (weights.sum() + 1))


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def calibration(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic fit with Platt's smoothed targets."""
    pos, neg = toxic.sum(), (1 - toxic).sum()
    y = np.where(toxic > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * (theta - [1.0, 0.0]))
        theta = theta + step
        if abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def relevance(with_term: np.ndarray, toxic: np.ndarray, base: float) -> np.ndarray:
    """How far the share of toxic examples among those with a term is from the base rate, in log odds, plus FLOOR."""
    odds = (toxic + PRIOR * base) / (with_term - toxic + PRIOR * (1 - base))
    return FLOOR + np.abs(np.log(odds) - np.log(base / (1 - base)))


class Examples:
    """The examples as numbers: doc_ids, labels, terms and counts. Small enough to send by the bound of the sample."""

    def __init__(self, ids: list, toxic: np.ndarray, ptr: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.ids, self.toxic, self.ptr, self.counts = ids, toxic.astype(float), ptr, counts
        self.keys, self.terms = np.unique(keys, return_inverse=True)
        self.base = (self.toxic.sum() + 1) / (len(ids) + 2) if self.toxic.any() else 0.0
        bare = np.diff(ptr) == 0
        self.bare = float((self.toxic[bare].sum() + self.base) / (bare.sum() + 1)) if self.toxic.any() else 0.0

    def weigh(self, df: np.ndarray, n: int) -> None:
        """df: documents of n that hold each term."""
        self.idf_of_none = np.log(1.0 + n) + 1
        held = np.bincount(self.terms, minlength=len(self.keys)).astype(float)
        toxic = np.bincount(self.terms, np.repeat(self.toxic, np.diff(self.ptr)), minlength=len(self.keys))
        self.weights = (np.log((1 + n) / (1 + df)) + 1) * (relevance(held, toxic, self.base) if self.base else 1.0)
        del self.keys

    def unit(self, terms: np.ndarray, counts: np.ndarray, rest: float = 0.0) -> np.ndarray:
        """Weights of a text's terms, of length 1 together with `rest`, the squared sum of terms that no example holds."""
        w = (1 + np.log(counts)) * self.weights[terms]
        return w / np.sqrt(w @ w + rest * (FLOOR * self.idf_of_none) ** 2)

    def index(self) -> BlockMaxIndex:
        """Built once in each worker."""
        if not hasattr(self, "_index"):
            w = (1 + np.log(self.counts)) * self.weights[self.terms]
            rows = np.repeat(np.arange(len(self.ids)), np.diff(self.ptr))
            norm = np.sqrt(np.bincount(rows, w * w, minlength=len(self.ids)))
            self._index = BlockMaxIndex(self.ptr, self.terms, w / norm[rows], len(self.weights))
        return self._index

    def votes(self, i: int) -> float:
        """The vote of the other examples on example i, as a logit."""
        part = slice(self.ptr[i], self.ptr[i + 1])
        return logit(vote(self.index().search(self.terms[part], self.unit(self.terms[part], self.counts[part]), K, without=i), self.toxic, self.base))

    def score(self, terms: np.ndarray, counts: np.ndarray, rest: float, slope: float, shift: float) -> tuple[float, list[tuple[float, int]]]:
        if not len(terms) or not self.base:
            return self.bare, []
        found = self.index().search(terms, self.unit(terms, counts, rest), K)
        z = slope * logit(vote(found, self.toxic, self.base)) + shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), found


def _leave_one_out(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array([shared.value.votes(k) for k in i], pa.float64())], names=["i", "x"])

    return run


def _scorer(shared, slope: float, shift: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = shared.value
        known: dict[tuple, tuple] = {}  # copies of a text are looked up once
        for b in batches:
            terms, counts = b.column(1), b.column(2)
            at, t, c = terms.offsets.to_numpy(), terms.values.to_numpy(), counts.values.to_numpy()
            scores, near, sims = [], [], []
            for k, rest in enumerate(b.column(3).to_pylist()):
                part = slice(at[k], at[k + 1])
                key = t[part].tobytes(), c[part].tobytes(), rest
                if (r := known.get(key)) is None:
                    if len(known) > 5000:
                        known.clear()
                    r = known[key] = examples.score(t[part], c[part], rest, slope, shift)
                s, found = r
                scores.append(s)
                near.append([examples.ids[i] for _, i in found[:K]])
                sims.append([x for x, _ in found[:K]])
            yield answer(b, _tx_score=pa.array(scores, pa.float64()), _tx_near=pa.array(near, pa.list_(kind)), _tx_sims=pa.array(sims, pa.list_(pa.float64())))

    return run


def fitted(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Examples:
    """The sample of labelled rows with the counts of their terms; document frequencies are still to come."""
    spark = docs.sparkSession
    sample = stored(spark, labelled(labels.select("doc_id", "toxic"), max_examples), "toxicity-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(_example_terms, f"doc_id {kind}, toxic int, keys array<bigint>, counts array<int>").toArrow().sort_by("doc_id")
    sizes = pc.list_value_length(rows["keys"]).to_numpy()
    flat = {c: pc.list_flatten(rows[c]).to_numpy() for c in ("keys", "counts")}
    return Examples(rows["doc_id"].to_pylist(), rows["toxic"].to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat["keys"], flat["counts"])


RESULTS = ("_tx_score", "_tx_near", "_tx_sims")


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """Columns `keep`, _tx_score (0 to 1), _tx_near and _tx_sims (the examples behind it and their cosines)."""
    spark = docs.sparkSession
    kept = others(keep, RESULTS)
    examples = fitted(docs, labels, max_examples)
    keys = spark.sparkContext.broadcast(examples.keys.tobytes())
    source = docs.select(packed(kept), F.col("text"))
    counts = stored(spark, mapped(source, _counter(keys), "terms array<int>, counts array<int>, rest double"), "toxicity-counts")
    df = np.zeros(len(examples.keys))
    held = counts.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # a row for each term of the examples at most
    df[held["t"].to_numpy()] = held["count"].to_numpy()
    examples.weigh(df, counts.count())
    slope, shift = 1.0, 0.0
    if examples.base:
        shared = spark.sparkContext.broadcast(examples)
        with_terms = [(i,) for i in np.flatnonzero(np.diff(examples.ptr)).tolist()]
        numbers = spark.createDataFrame(with_terms, "i bigint").repartition(max(1, min(64, len(with_terms) // 100)))
        x = numbers.mapInArrow(_leave_one_out(shared), "i bigint, x double").toArrow()
        order = np.argsort(x["i"].to_numpy())
        slope, shift = calibration(x["x"].to_numpy()[order], examples.toxic[x["i"].to_numpy()[order]])
    else:
        shared = spark.sparkContext.broadcast(examples)
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    out = mapped(counts, _scorer(shared, slope, shift, arrow), f"_tx_score double, _tx_near array<{'string' if kind == 'string' else 'bigint'}>, _tx_sims array<double>")
    return unpacked(out, kept, *RESULTS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (fold() == 0).alias("held_out"), F.col("_tx_score").alias("score"), (F.col("_tx_score") >= 0.5).cast("int").alias("predicted"))


def brute_force(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """(doc_id, score) of (doc_id, text) rows with distinct doc_ids: dense cosines with all examples, for tests."""
    import math
    import zlib

    counts = {d: term_counts(t) for d, t in docs}
    mark: dict[int, int] = {}
    for d, y in labels:
        if d is not None and y is not None and zlib.crc32(str(d).encode()) % 5 and d in counts:
            mark[d] = max(y, mark.get(d, 0))
    ids = sorted(mark)
    base = (sum(mark.values()) + 1) / (len(ids) + 2)
    df = Counter(t for c in counts.values() for t in c)
    held, toxic = Counter(t for i in ids for t in counts[i]), Counter(t for i in ids if mark[i] for t in counts[i])

    def weight(t: str) -> float:
        if t not in held:
            return FLOOR * (math.log(1 + len(docs)) + 1)
        odds = (toxic[t] + PRIOR * base) / (held[t] - toxic[t] + PRIOR * (1 - base))
        return (math.log((1 + len(docs)) / (1 + df[t])) + 1) * (FLOOR + abs(math.log(odds) - math.log(base / (1 - base))))

    def vector(c: Counter) -> dict[str, float]:
        w = {t: (1 + math.log(n)) * weight(t) for t, n in c.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    column = {t: k for k, t in enumerate(held)}
    matrix = np.zeros((len(ids), len(column)))
    for r, i in enumerate(ids):
        for t, w in vector(counts[i]).items():
            matrix[r, column[t]] = w
    marks = np.array([mark[i] for i in ids], dtype=float)

    def voted(d: int, leave: bool) -> float:
        q = np.zeros(len(column))
        for t, w in vector(counts[d]).items():
            if t in column:
                q[column[t]] = w
        cos = np.round(matrix @ q, 12)
        if leave:
            cos[ids.index(d)] = 0
        kth = np.sort(cos)[-min(K, len(cos))]
        near = [i for i in range(len(ids)) if cos[i] > 0 and cos[i] >= kth]
        above, at = sum(cos[i] > kth for i in near), sum(cos[i] == kth for i in near)
        w = [(1 if cos[i] > kth else min(1, (K - above) / at)) / (1 - cos[i] + SOFT) for i in near]
        return logit((sum(x * marks[i] for x, i in zip(w, near)) + base) / (sum(w) + 1))

    slope, shift = calibration(np.array([voted(i, True) for i in ids if counts[i]]), np.array([float(mark[i]) for i in ids if counts[i]]))
    bare = [mark[i] for i in ids if not counts[i]]
    out = []
    for d, _ in docs:
        known = any(t in column for t in counts[d])
        z = slope * voted(d, False) + shift if known else 0.0
        out.append((d, 1 / (1 + math.exp(-min(30, max(-30, z)))) if known else (sum(bare) + base) / (len(bare) + 1)))
    return out
