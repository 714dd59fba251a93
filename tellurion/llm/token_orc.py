"""Token ids in ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by doc_id, encoded where they lie, and written by Spark's ORC writer: its
integer columns are run-length encoded (RLEv2), each stripe carries a row index with the least and greatest doc_id of
every ROWS_PER_INDEX rows, and a Bloom filter on doc_id. Readers split files by stripe and skip stripes and row groups
whose metadata cannot match. `start` is not stored: it is the running sum of lengths, made from totals by
partition (one row each) and the order within each, so that no task sees all documents.

Defined cases: null or empty text is the end id alone; repeated doc_ids lie next to each other, ordered by text, and each
has its own row; null doc_ids come first; a very long text is cut as a slice of its own; an empty table leaves files
without rows; other columns, whatever their names, are not written.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, table
from .units import Units

END = 2
#: Units in each of the two generations of a worker's cache.
CACHE = 200_000
#: Bytes of text that are cut at a time.
SLICE = 6 << 20
ROWS_PER_INDEX = 1000
STRIPE_BYTES = 16 << 20


class ByteBPE:
    """The tokenizers library behind a cache of units.

    The vocabulary's word pattern begins a word at each blank with no white space in front, so a text is cut there into
    stretches; the distinct ones are cut once more where the pattern cuts in any case: behind letters or digits that an
    ASCII mark follows, and around a line feed that a letter, digit or mark follows. Arrow cuts a batch of texts and
    numbers its distinct units; Python looks up only those, and the library sees those that are not cached. A stretch of
    white space behind white space is no word of its own; texts with one, with a special token's string or with NUL go to
    the library whole.
    """

    MARK = "!-/:-@\\[-`{-~"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.units = Units(self.whole, CACHE)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids."""
        found = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))

    def stretches(self, found: pa.StringArray) -> pa.ListArray:
        """Ids of distinct stretches."""
        units = pc.replace_substring_regex(found, rf"\n([\pL\pN{self.MARK}])", "\0\n\0\\1")
        units = pc.split_pattern(pc.replace_substring_regex(units, rf"([\pL\pN])([{self.MARK}\n])", "\\1\0\\2"), "\0")
        ids = self.units.ids(units.flatten().dictionary_encode())
        return pa.ListArray.from_arrays(ids.offsets.take(units.offsets), ids.values)

    def encode(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a batch, `end` after each text."""
        odd = np.zeros(len(texts), bool)
        for s in ("\0", *self.special):
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        coded = cut.flatten().dictionary_encode()
        at, of = coded.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        # white space that goes on over the beginning of a stretch and beyond its blank
        ends = pc.utf8_is_space(pc.utf8_slice_codeunits(coded.dictionary, -1)).to_numpy(zero_copy_only=False)
        goes_on = pc.or_(pc.equal(coded.dictionary, " "), pc.utf8_is_space(pc.utf8_slice_codeunits(coded.dictionary, 1, 2))).to_numpy(zero_copy_only=False)
        blank = np.flatnonzero(ends[at[:-1]] & goes_on[at[1:]]) + 1
        blank = blank[~np.isin(blank, of)]
        odd[np.searchsorted(of, blank, "right") - 1] = True
        taken = self.stretches(coded.dictionary).take(pa.array(at))
        offsets = taken.offsets.to_numpy()[of]
        ids = taken.values.to_numpy()
        if odd.any():
            sizes = np.diff(offsets)
            whole_sizes, whole_ids = self.whole(texts.filter(pa.array(odd)).to_pylist())
            own = np.split(whole_ids, np.cumsum(whole_sizes)[:-1])
            sizes[odd] = whole_sizes
            rest = iter(own)
            ids = np.concatenate([next(rest) if odd[k] else ids[offsets[k] : offsets[k + 1]] for k in range(len(texts))])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        return offsets + np.arange(len(offsets)), np.insert(ids, offsets[1:], end)


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBPE:
    """One for each Python worker: its cache serves all tasks of the worker."""
    return ByteBPE(path)


def _encoder(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, number, seq = coder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            for part in slices(b, 1, SLICE):
                gc.disable()  # very many small objects and no cycles
                try:
                    offsets, ids = c.encode(part.column(1), end)
                finally:
                    gc.enable()
                n = part.num_rows
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                columns = [part.column(0), pa.array([number] * n, pa.int32()), pa.array(np.arange(seq, seq + n)), pa.array(np.diff(offsets).astype(np.int64)), lists]
                seq += n
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "seq", "n_tokens", "ids"])

    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end: int = END, partitions: int | None = None) -> None:
    """Ids of each text and the end id, in ascending doc_id order over the files of `out`."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*([partitions] if partitions else []), "doc_id").sortWithinPartitions("doc_id", "text")
    tokens = rows.mapInArrow(_encoder(path or tokenizer_path(), end), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, seq bigint, n_tokens bigint, ids array<int>")
    tokens.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(ROWS_PER_INDEX)).option(
        "orc.stripe.size", str(STRIPE_BYTES)
    ).option("compression", "snappy").orc(out)


def read_tokens(spark: SparkSession, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids. With doc_ids the predicate reaches the stripes' statistics and Bloom filters."""
    df = spark.read.orc(out)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(b.num_columns - 1)
        offsets, values = lists.offsets.to_pylist(), lists.values.cast(pa.int32())
        data = memoryview(values.buffers()[1]) if len(values) else memoryview(b"")
        base = values.offset
        crcs = [zlib.crc32(data[4 * (base + s) : 4 * (base + e)]) for s, e in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crcs, pa.int64())], names=[*b.schema.names[:-1], "ids_crc32"])


def token_index(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of files that write_tokens left, read back stripe by stripe."""
    stored = spark.read.orc(out)
    kind = stored.schema["doc_id"].dataType.simpleString()
    found = stored.select("doc_id", "part", "seq", "n_tokens", "ids").mapInArrow(_crc, f"doc_id {kind}, part int, seq bigint, n_tokens bigint, ids_crc32 bigint")
    # one row a partition: this window and its broadcast hold as many rows as there are files
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return found.withColumn("inner", inner).join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), out)
    return token_index(spark, out)


def brute_force(docs: list[tuple], path: str | None = None, end: int = END) -> list[tuple]:
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path or tokenizer_path())
    out, start = [], 0
    for doc_id, text in sorted(docs):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    return out
