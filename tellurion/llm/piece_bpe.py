"""Exact merge-type encoding with a sentencepiece BPE vocabulary, by backtracking.

For a stretch of text, Aho-Corasick finds the longest piece at each position; the encoder walks left to right, tries it
and then the shorter pieces that it begins with, and accepts one only if it is compatible with the piece before: merging the two pieces' characters again by rank must
give just these two. A bitfield marks positions from which no tail could be completed, so none is tried twice. Accepted
sequences are exactly what rank-ordered merging gives. Characters without a piece of their own become bytes.

Scale: a map over rows without a shuffle; tasks hold the vocabulary and a bounded cache of units. Text is cut before each
run of blanks, which no merge of a vocabulary crosses whose pieces have blanks only in front (checked when loading;
otherwise texts are not cut), and before marks that no piece has behind a letter, say.

Defined cases: null and empty text encode to begin and end only; any other string, NUL and lone blanks included,
round-trips; time and memory grow in proportion to a text's length, unbroken text included; of pieces with equal scores
the leftmost merges first; repeated rows are each encoded; other columns are carried on unseen, but a caller's column
with the name of a result gives way.
"""

from __future__ import annotations

import gc
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answer, mapped, others, packed, slices, table, unpacked
from .units import Units

BLANK = "▁"
#: Units in each of the two generations of a worker's cache, and pairs of pieces.
CACHE = 200_000
#: Bytes of text that are cut at a time.
SLICE = 6 << 20


class PieceBPE:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        #: What each id adds to a decoded text.
        self.out = [b""] * n
        for i in plain:
            self.out[i] = pieces[i].replace(BLANK, " ").encode()
        for b, i in self.byte_ids.items():
            self.out[i] = bytes([b])
        self.out[sp.unk_id()] = " ⁇ ".encode()
        self.byte_set = frozenset(self.byte_ids.values())
        self.ids = {pieces[i]: i for i in plain}
        # equal scores are of equal rank: the leftmost of them merges first
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {pieces[i]: order[sp.get_score(i)] for i in plain}
        self.text = {i: pieces[i] for i in plain}
        self.cuttable = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.known = {p for p in self.ids if len(p) == 1}
        self.odd = re.compile("[^" + "".join(map(re.escape, sorted(self.known))) + "]+")
        self.trie = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.trie.add_word(p, (len(p) - 1, i))
        self.trie.make_automaton()
        self.size = list(map(len, pieces))
        #: The longest piece that begins a piece and is shorter than it, or -1.
        self.shorter = [-1] * n
        for p, i in self.ids.items():
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.units = Units(self.stretches, CACHE)
        #: ASCII marks that no piece has behind a letter or decimal digit: a text is cut there.
        marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}
        inside = {b for p in self.ids for a, b in pairwise(p) if b in marks and (unicodedata.category(a)[0] == "L" or unicodedata.category(a) == "Nd")}
        self.cut_before = "".join(rf"\x{ord(c):02x}" for c in sorted(marks - inside))
        lengths = np.fromiter(map(len, self.out), np.int64, n)
        self.bytes_of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.frombuffer(b"".join(self.out), np.uint8)))

    def merged(self, chars: str) -> list[str]:
        """Rank-ordered merging, leftmost first among equals; for single pairs of pieces."""
        parts, rank = list(chars), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) > 4 * CACHE:
            self.pairs.clear()
        x, y = self.text[a], self.text[b]
        known = self.pairs[a << 32 | b] = self.merged(x + y) == [x, y]
        return known

    def backtrack(self, s: str) -> list[int]:
        """Ids of a stretch whose characters all have pieces."""
        n, size, shorter, pairs = len(s), self.size, self.shorter, self.pairs
        longest = [-1] * n if n < 1000 else array("i", [-1]) * n
        for end, (less, i) in self.trie.iter(s):
            longest[end - less] = i  # longer pieces from the same place end later
        failed = bytearray((n >> 3) + 1)  # the bitfield: positions from which no tail can be completed
        out: list[int] = []
        pos, last, i = 0, -1, longest[0] if n else -1
        while pos < n:
            while i >= 0:
                to = pos + size[i]
                if not failed[to >> 3] >> (to & 7) & 1:
                    if last < 0:
                        break
                    if (fits := pairs.get(last << 32 | i)) is None:
                        fits = self.compatible(last, i)
                    if fits:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                pos, last = to, i
                i = longest[pos] if pos < n else -1
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise ValueError("no encoding")
                pos -= size[out[-1]]
                i = shorter[out.pop()]
                last = out[-1] if out else -1
        return out

    def _stretch(self, s: str) -> list[int]:
        if not self.odd.search(s):
            return self.backtrack(s)
        ids: list[int] = []
        last = 0
        for m in self.odd.finditer(s):
            ids += self.backtrack(s[last : m.start()])
            ids += [self.byte_ids[b] for b in m[0].encode()]
            last = m.end()
        return ids + self.backtrack(s[last:])

    def stretches(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids."""
        found = list(map(self._stretch, units))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a batch, begin and end included.

        Arrow cuts the texts before each blank and, where the vocabulary allows it, before marks, and numbers the distinct
        units; Python sees only those. Texts with runs of blanks or with NUL are encoded one by one.
        """
        filled = pc.equal(pc.binary_length(texts), 0)
        marked = pc.if_else(filled, texts, pc.binary_join_element_wise(pa.scalar(BLANK), pc.replace_substring(texts, " ", BLANK), pa.scalar("")))
        odd = np.full(len(texts), not self.cuttable)
        for s in (BLANK * 2, "\0"):
            odd |= pc.match_substring(marked, s).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(marked, BLANK, "\0" + BLANK), "\0")
        coded = cut.flatten().dictionary_encode()
        units = pc.split_pattern(pc.replace_substring_regex(coded.dictionary, rf"([\pL\p{{Nd}}])([{self.cut_before}])", "\\1\0\\2") if self.cut_before else coded.dictionary, "\0")
        ids = self.units.ids(units.flatten().dictionary_encode())
        taken = pa.ListArray.from_arrays(ids.offsets.take(units.offsets), ids.values).take(coded.indices)
        offsets, ids = taken.offsets.to_numpy()[cut.offsets.to_numpy() - cut.offsets[0].as_py()], taken.values.to_numpy()
        if odd.any():
            parts = [np.frombuffer(self.encode(texts[k].as_py()), np.int32)[1:-1] if odd[k] else ids[offsets[k] : offsets[k + 1]] for k in range(len(texts))]
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        at = np.stack([offsets[:-1], offsets[1:]], axis=1).ravel()
        return offsets + 2 * np.arange(len(offsets)), np.insert(ids, at, np.tile([self.begin, self.end], len(texts)))

    def decode_all(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The decoded texts in UTF-8."""
        found = self.bytes_of.take(pa.array(ids))
        ends, raw = found.offsets.to_numpy()[offsets], found.values.to_numpy().tobytes()
        out = []
        for k in range(len(offsets) - 1):
            text = raw[ends[k] : ends[k + 1]]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self._decode_loose(array("I", ids[offsets[k] : offsets[k + 1]].tobytes())).encode()
            out.append(text[1:] if text[:1] == b" " else text)
        return out

    def encode(self, text: str) -> bytes:
        """Ids, begin and end included, as little-endian unsigned 32-bit integers."""
        ids = [self.begin]
        if not self.cuttable:
            ids += self._stretch(BLANK + text.replace(" ", BLANK)) if text else []
        elif text:
            for w in re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", BLANK + text.replace(" ", BLANK)):
                ids += self._stretch(w)
        return array("I", [*ids, self.end]).tobytes()

    def decode(self, ids: bytes) -> str:
        numbers = array("I", ids)
        raw = b"".join(map(self.out.__getitem__, numbers))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_loose(numbers)
        return text[1:] if text[:1] == " " else text

    def _decode_loose(self, numbers: array) -> str:
        """Each byte of a byte run that is not UTF-8 becomes a replacement character of its own."""
        out, run = [], b""
        for i in [*numbers, None]:
            if i in self.byte_set:
                run += self.out[i]
                continue
            while run:
                try:
                    out.append(run.decode())
                    break
                except UnicodeDecodeError as e:
                    out += [run[: e.start].decode(), "�"]
                    run = run[e.start + 1 :]
            run = b""
            if i is not None:
                out.append(self.out[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def coder(model: str) -> PieceBPE:
    """One for each Python worker: its caches serve all tasks of the worker."""
    return PieceBPE(model)


def _encoder(model: str, ids: bool, text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in (part for whole in batches for part in slices(whole, 1, SLICE)):
            gc.disable()  # very many small objects and no cycles
            try:
                offsets, values = c.encode_all(b.column(1))
                texts = c.decode_all(offsets, values)
            finally:
                gc.enable()
            raw = memoryview(np.ascontiguousarray(values, np.int32)).cast("B")
            own = {
                "n_tokens": pa.array(np.diff(offsets).astype(np.int64)),
                "ids_sha256": pa.array([hashlib.sha256(raw[4 * s : 4 * e]).hexdigest() for s, e in pairwise(offsets.tolist())], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            }
            if ids:
                own["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            if text:
                own["decoded"] = pa.array(texts, pa.binary()).cast(pa.string())
            yield answer(b, **own)

    return run


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids: bool = True, text: bool = False) -> DataFrame:
    """Columns `keep`, n_tokens, ids_sha256, decoded_sha256, then ids and the text decoded from them where asked for."""
    own = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * text
    names = [x.split()[0] for x in own.split(", ")]
    kept = others(keep, names)
    source = docs.select(packed(kept), F.coalesce("text", F.lit("")).alias("text"))
    return unpacked(mapped(source, _encoder(model or model_path(), ids, text), own), kept, *names)


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False)
