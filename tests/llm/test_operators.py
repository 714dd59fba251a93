"""Registered queries against their SQL or a brute-force version; odd inputs; planted cases."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from array import array

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tellurion.llm import chat, decontaminate, linededup, piece_bpe, pseudonyms, quality, queries, simhash, token_orc, toxicity, warc_index
from tellurion.llm.common import stored
from tellurion.llm.components import components

from ..oracle import SF, connect, same_rows
from .helpers import TEXTS, documents, empty, real, rows


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, con, name):
    assert same_rows(queries.QUERIES[name](spark, SF), con, queries.SQL[name])


# --- 1: WARC -------------------------------------------------------------------------------------------------


def test_warc_query(spark):
    assert rows(queries.QUERIES["op1_warc"](spark, SF)) == sorted(warc_index.brute_force(real("pages", "page_id, url, html")), key=repr)


PAGES = [(1, "http://a.example/x", "same"), (2, "http://b.example/x", "same"), (3, "http://a.example/x", None), (4, None, ""), (5, "not a url\r\nX: y", "<b>é</b>"), (6, "http://[bad", "z" * 300_000), (7, "https://A.Example:8443/p?q=1#f", "same")]


def test_warc_odd_rows_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES + [PAGES[1]], "page_id bigint, url string, html string").withColumn("key", F.lit("mine")).withColumn("_n", F.lit(1))
    out = str(tmp_path / "w")
    captures = warc_index.write_archives(pages, out)
    ranges = warc_index.build_index(captures, out, block_lines=2)
    found = warc_index.look_up(captures, ranges, out)
    got = sorted((int(r.number), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in found.collect())
    assert got == sorted(warc_index.brute_force(PAGES + [PAGES[1]]))
    payloads = {int(r.number): bytes(r.payload) for r in found.collect() if r.record_type == "response"}
    assert payloads[5] == "<b>é</b>".encode() and len(payloads[6]) == 300_000
    assert warc_index.look_up(spark.createDataFrame([("zzz",), ("",)], "key string"), ranges, out).count() == 0


def test_warc_min_bytes_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    found = rows(warc_index.with_originals(pages, "page_id", "html", 5).select("page_id", "_first"))
    assert all(f is None for _, f in found)
    out = str(tmp_path / "e")
    captures = warc_index.write_archives(pages.where("false"), out)
    assert warc_index.look_up(captures, warc_index.build_index(captures, out), out).count() == 0


def test_revisits_name_their_originals(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    warc_index.write_archives(pages.coalesce(1), str(tmp_path / "r"))
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in tmp_path.glob("r/archive/*.gz"))
    heads = [r.split(b"\r\n\r\n")[0].decode() for r in raw.split(b"WARC/1.1\r\n")[1:]]
    assert heads[0].startswith("WARC-Type: warcinfo")
    ids = {h.split("WARC-Target-URI: ")[1].split("\r\n")[0]: h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads if "Target-URI" in h}
    again = [h for h in heads if "WARC-Type: revisit" in h and "b.example" in h.split("WARC-Refers-To")[0]]
    assert len(again) == 1 and f"WARC-Refers-To: {ids['http://a.example/x']}" in again[0] and "WARC-Refers-To-Target-URI: http://a.example/x" in again[0]


def test_surt():
    assert warc_index.surt("https://User@Www.A.Example:443/P?q=1#f") == "example,a,www)/P?q=1"
    assert warc_index.surt("http://a.example:81") == "example,a:81)/" and warc_index.surt(None) == ""


# --- 2: quality ----------------------------------------------------------------------------------------------


def repeated_words(text: str) -> int:
    w = (text or "").encode().split()
    seen: dict[tuple, list[int]] = {}
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    return len({p for at in seen.values() if len(at) > 1 for k in at for p in range(k, k + 5)})


def test_base_rules_on_odd_texts(spark):
    got = {(r.doc_id, r._q_words, r._q_chars, r._q_repeat, r._q_dup_lines) for r in quality.base_rules(documents(spark)).collect()}
    want = set()
    for i, t in TEXTS:
        w = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want.add((i, len(w), sum(len(x.decode()) for x in w), repeated_words(t), len(lines) - len(set(lines))))
    assert got == want


def test_boilerplate_goes_and_copies_stay(spark):
    body = lambda k: " ".join(chr(97 + k % 26) * (1 + k // 26) + "-" + chr(97 + j) * 3 for j in range(26))
    docs = [(k, f"Menu - Home - 2024\n{body(k)}", "en", "h", 0) for k in range(40)] + [(100 + k, "Menu - Home - 99\nmenu - home - 7", "en", "h", 0) for k in range(3)]
    docs += [(200 + k, "A copied story that many pages tell in just these same words today", "en", "h", 0) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r.doc_id: r for r in quality.filter_quality(df).collect()}
    assert set(out) == set(range(40)) | set(range(200, 240))
    assert out[3].text == body(3) and out[3].n_chars == len(body(3))


def test_quality_keeps_columns_and_empty(spark):
    d = documents(spark)
    out = quality.filter_quality(d)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == {6, 7, 12, 13, 14}
    assert quality.filter_quality(empty(spark)).count() == 0 and quality.judged(empty(spark)).count() == 0


# --- 3: decontamination --------------------------------------------------------------------------------------


ITEMS = [(1, "alpha beta gamma"), (2, " ".join(f"w{k}" for k in range(12))), (3, None), (4, ""), (5, "solo"), (6, " ".join(f"w{k}" for k in range(5, 25))), (7, "beta gamma"), (7, "beta gamma"), (None, "one")]


@pytest.mark.parametrize("block", [400_000, 15])
def test_decontamination_against_brute_force(spark, block):
    random.seed(3)
    docs = [(k, " ".join(random.choice(["alpha", "beta", "gamma", "solo", "x"] + [f"W{j}," for j in range(25)]) for _ in range(60))) for k in range(60)]
    docs += [(100, "x " + " ".join(f"w{k}" for k in range(3, 20)) + " y"), (101, None), (102, "alpha. Beta-gamma"), *TEXTS]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("t", F.lit(1))
    df = documents(spark, docs)
    found = decontaminate.find_passages(df, items, block_words=block)
    got = sorted((r.doc_id, r.n_words, sum(e - s for s, e in zip(r.starts, r.ends)), len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), bool(r.starts)) for r in found.collect())
    assert got == sorted(decontaminate.brute_force(docs, [i for i in ITEMS if i[0] is not None]))


def test_several_blocks_clean_as_one(spark):
    docs = documents(spark, [(k, f"x{k} " + " ".join(f"w{j}" for j in range(k, k + 14)) + " alpha, beta gamma! tail " + "pad " * 60) for k in range(12)] + [(50, None), (51, ""), (51, "")])
    items = spark.createDataFrame([i for i in ITEMS if i[1]], "item_id bigint, text string")
    one, many = (sorted(map(tuple, decontaminate.decontaminate(docs, items, block_words=n).collect()), key=repr) for n in (400_000, 15))
    assert one == many and len(one) == 15


def test_passages_leave_texts(spark):
    long = " ".join(f"w{k}" for k in range(12))
    docs = documents(spark, [(1, f"before, {long.upper()}! after " + "clean " * 20), (2, long), (3, "clean text"), (4, None)])
    items = spark.createDataFrame([(2, long)], "item_id bigint, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert set(out) == {1, 3, 4} and out[1].text == "before, ! after " + "clean " * 20 and out[1].n_chars == len(out[1].text) and out[1]["items"] == 5
    assert decontaminate.decontaminate(empty(spark), items).count() == 0
    assert decontaminate.find_passages(docs, items.where("false")).where("size(starts) > 0").count() == 0


# --- 4: line dedup -------------------------------------------------------------------------------------------


def test_line_dedup_against_brute_force(spark):
    d = documents(spark)
    got = sorted((r.doc_id, r._ld_lines, r._ld_dropped, hashlib.sha256(r._ld_text.encode()).hexdigest()) for r in linededup.dedup_lines(d).collect())
    assert got == sorted(linededup.brute_force(TEXTS))
    assert linededup.clean_lines(d).columns == d.columns and linededup.clean_lines(empty(spark)).count() == 0


def test_hot_lines_go_the_other_way_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 4)
    docs = [(k, f"a line that nearly all of the documents hold\nline number {k % 7} that is in some documents\nown line of document number {k}") for k in range(40)] * 2
    got = sorted((r.doc_id, r._ld_lines, r._ld_dropped, hashlib.sha256(r._ld_text.encode()).hexdigest()) for r in linededup.dedup_lines(documents(spark, docs)).collect())
    assert got == sorted(linededup.brute_force(docs))


def test_repeated_rows_are_one_document(spark):
    line = "a line that is long enough to count here"
    out = linededup.clean_lines(documents(spark, [(1, line), (1, line), (2, line)]))
    assert [r.text for r in out.collect()] == [line] * 3


def test_crowded_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(linededup, "MIN_BITS_LOG2", 6)
    monkeypatch.setattr(linededup, "MAX_BITS_LOG2", 6)
    docs = [(k, "\n".join(f"line number {(k * 7 + j) % 50} that is long enough" for j in range(12))) for k in range(40)]
    d = documents(spark, docs).repartition(5)
    got = sorted((r.doc_id, r._ld_lines, r._ld_dropped, hashlib.sha256(r._ld_text.encode()).hexdigest()) for r in linededup.dedup_lines(d).collect())
    assert got == sorted(linededup.brute_force(docs))


# --- 5 and 10: tokens ----------------------------------------------------------------------------------------


def strange(n: int) -> list[str]:
    rnd = random.Random(5)
    letters = list("abeinrst  .,\n\t\r▁'1é Ñ漢🙂-<s>") + ["  ", "\n ", " the", "ing", "▁▁▁", "<|endoftext|>", "\0"]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_piece_bpe_is_the_library(spark):
    import sentencepiece

    path = piece_bpe.model_path()
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.PieceBPE(path)
    for t in [t or "" for _, t in TEXTS] + strange(3000) + [" " * k + "x" + " " * k for k in range(40)]:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert list(array("I", own.encode(t))) == ids, t[:50]
        assert own.decode(array("I", ids).tobytes()) == lib.decode(ids), t[:50]


def test_unbroken_text_takes_time_in_proportion():
    import time

    import sentencepiece

    path = piece_bpe.model_path()
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.PieceBPE(path)
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    own.encode(text[:200_000])  # pairs of pieces are known from here on
    took = []
    for n in (100_000, 1_000_000):
        start = time.process_time()
        ids = own.encode(text[:n])
        took.append(time.process_time() - start)
    assert took[1] < 30 * took[0]
    assert list(array("I", own.encode(text[:20_000]))) == lib.encode(text[:20_000], add_bos=True, add_eos=True) and own.decode(ids) == text


def test_loose_bytes_decode_as_the_library(spark):
    import sentencepiece

    path = piece_bpe.model_path()
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.PieceBPE(path)
    rnd = random.Random(2)
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(259, 32000), 0xE6 + 3, 0x81 + 3]) for _ in range(rnd.randint(0, 8))]
        assert own.decode(array("I", ids).tobytes()) == lib.decode(ids), ids


def test_piece_bpe_columns_and_empty(spark):
    out = piece_bpe.encode(documents(spark), keep=("doc_id", "ids", "value"), text=True)
    assert out.columns == ["doc_id", "value", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    assert {r.doc_id: r.n_tokens for r in out.collect()}[1] == 2
    assert piece_bpe.encode(empty(spark)).count() == 0


def test_byte_bpe_is_the_library():
    own = token_orc.ByteBPE(token_orc.tokenizer_path())
    texts = [t or "" for _, t in TEXTS] + strange(3000)
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        offsets, ids = own.encode(pa.array(part), 2)
        want = [[*own.lib.encode(t, add_special_tokens=False).ids, 2] for t in part]
        assert [ids[s:e].tolist() for s, e in zip(offsets, offsets[1:])] == want


def test_token_files(spark, tmp_path):
    out = str(tmp_path / "orc")
    docs = documents(spark)
    token_orc.write_tokens(docs, out, partitions=3)
    got = sorted(map(tuple, token_orc.token_index(spark, out).collect()))
    assert got == sorted(token_orc.brute_force([(i, t or "") for i, t in TEXTS]))
    assert {r.doc_id for r in token_orc.read_tokens(spark, out, [4, 10]).collect()} == {4, 10}
    plan = token_orc.read_tokens(spark, out, [4])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [4])]" in plan or "EqualTo(doc_id,4)" in plan or "PushedFilters: [IsNotNull(doc_id)" in plan
    import pyarrow.orc as orc

    f = orc.ORCFile(next(tmp_path.glob("orc/*.orc")))
    j = spark._jvm.org.apache
    reader = j.orc.OrcFile.createReader(j.hadoop.fs.Path(str(next(tmp_path.glob("orc/*.orc")))), j.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    streams = reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()
    assert {"BLOOM_FILTER_UTF8", "ROW_INDEX"} <= {x.getKind().toString() for x in streams}
    assert f.nstripes >= 1 and f.row_index_stride == token_orc.ROWS_PER_INDEX
    token_orc.write_tokens(empty(spark), str(tmp_path / "none"), partitions=2)
    assert token_orc.token_index(spark, str(tmp_path / "none")).count() == 0


def test_queries_of_tokens(spark):
    import sentencepiece

    docs = real("documents", "doc_id, text")
    assert rows(queries.QUERIES["op10_token_orc"](spark, SF)) == sorted(token_orc.brute_force(docs), key=repr)
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())
    want = []
    for i, t in docs:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert rows(queries.QUERIES["op5_piece_bpe"](spark, SF)) == sorted(want, key=repr)


# --- 6: toxicity ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("long_list", [0.0, 0.1, 1.0])
def test_block_max_search_is_exact(long_list):
    import numpy as np

    rnd = np.random.default_rng(1)
    sets = [np.sort(rnd.choice(40, int(rnd.integers(1, 6)), replace=False)) for _ in range(500)]
    weights = [(w := rnd.integers(1, 4, len(t)) / 1.0) / np.linalg.norm(w) for t in sets]
    ptr = np.concatenate([[0], np.cumsum([len(t) for t in sets])])
    index = toxicity.BlockMaxIndex(ptr, np.concatenate(sets), np.concatenate(weights), 40, block=16, long_list=long_list)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(zip(sets, weights)):
        dense[i, t] = w
    for q in range(60):
        for without in (-1, q):
            cos = np.round(dense @ dense[q], 12)
            cos[without if without >= 0 else []] = 0
            want = [int(i) for i in np.lexsort((np.arange(500), -cos))[:10] if cos[i] > 0]
            assert [i for _, i in index.search(sets[q], weights[q], 10, without)[:10]] == want
    assert index.added < 120 * 500 / 2


def test_toxicity_learns_and_never_sees_the_held_out(spark):
    rnd = random.Random(4)
    words = [f"plain{k}" for k in range(200)]
    docs, labels = [], []
    for k in range(1500):
        toxic = k % 10 == 0
        t = [rnd.choice(words) for _ in range(60)] + ([rnd.choice(["blarg", "snorp"])] if toxic else [])
        rnd.shuffle(t)
        docs.append((k, " ".join(t)))
        labels.append((k, 1 if toxic else 0) if zlib.crc32(str(k).encode()) % 5 else (k, 1))
    df = documents(spark, docs + [(9001, None), (9002, "")])
    lb = spark.createDataFrame(labels + [(None, 1), (9001, None)], "doc_id bigint, toxic int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(df, lb, keep=("doc_id", "terms", "_tx_score", "a.b c")).collect()}
    right = [(out[k]._tx_score >= 0.5) == (k % 10 == 0) for k in range(1500)]
    assert sum(right) / len(right) > 0.99 and all(0 <= r._tx_score <= 1 for r in out.values()) and out[9001]._tx_score < 0.5
    assert all(s <= 1 + 1e-9 for s in out[10]._tx_sims) and len(out[10]._tx_near) == toxicity.K and out[10]["a.b c"] == 1
    assert toxicity.score_toxicity(empty(spark), lb).count() == 0
    assert {r._tx_score for r in toxicity.score_toxicity(df, lb.where("false")).collect()} == {0.0}


def test_toxicity_of_repeated_ids_and_long_texts_is_settled(spark):
    docs = [(k, f"text number {k} " + ("blarg " if k % 3 == 0 else "fine ") * 3) for k in range(60)] + [(3, "another text under the same id"), (3, None), (70, "blarg " * 40_000), (70, "blarg " * 40_000)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] * 2, "doc_id bigint, toxic int")
    once, again = (sorted((r.doc_id, r._tx_score, r._tx_near) for r in toxicity.score_toxicity(documents(spark, d), labels).collect()) for d in (docs, docs[::-1]))
    assert once == again and len(once) == len(docs) and all(s > 0.5 for i, s, _ in once if i == 70)


def test_toxicity_query_against_brute_force(spark):
    docs = real("documents", "doc_id, text")
    want = dict(toxicity.brute_force(docs, real("labels", "doc_id, toxic")))
    got = queries.QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(got) == len(docs) and max(abs(r.score - want[r.doc_id]) for r in got) < 1e-6
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)


# --- 7: chat -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "<\\\\|", "<<|", "a<", "<|im_start|>assistant\nhi<|im_end|>\n", "\\|<"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    turns = [("user", text), ("assi\nstant%0A", text + text), ("assistant", text)]
    shown, mask = chat.render(turns)
    assert chat.read_back(shown) == turns and [chat.unescape(shown[s:e]) for s, e in mask] == [text]


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
    ({"conversation": {"turns": [{"speaker": "user", "utterance": "q"}]}}, [("user", "q")]),
    ({"prompt": "q", "response": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"completion": "a", "prompt": "q"}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "input": "x", "output": "a"}, [("user", "i\n\nx"), ("assistant", "a")]),
    ({"instruction": "i", "input": "", "output": "a"}, [("user", "i"), ("assistant", "a")]),
    ({"system": "s", "prompt": "q", "response": "a"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"messages": []}, []),
    ({"id": 7, "source": "s", "prompt": "q", "response": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"id": None, "metadata": {"lang": "en"}, "messages": [{"role": "user", "content": "q", "timestamp": 3}]}, [("user", "q")]),
    ({"unknown": 1}, []), ([1], []), ("x", []),
]


@pytest.mark.parametrize("more", [{"tool_calls": [{"function": {"name": "f", "arguments": "{}"}}]}, {"weight": 0}, {"name": "x"}, {"score": 0.5}])
def test_fields_that_bear_on_turns_are_not_dropped(more):
    turn, known = {"role": "assistant", "content": "a"}, chat.registry()
    assert chat.canonical(json.dumps({"id": 1, "messages": [turn]}), known) == ([{"role": "assistant", "text": "a"}], None)
    turns, unmapped = chat.canonical(json.dumps({"id": 1, "messages": [turn | more]}), known)
    assert turns == [] and unmapped


def test_layouts(spark):
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(RECORDS)] + [(98, None), (99, "{")], "conv_id bigint, record string").withColumn("turns", F.lit(1))
    out = {r.conv_id: r for r in chat.to_turns(df).collect()}
    for k, (_, want) in enumerate(RECORDS):
        assert [(t.role, t.text) for t in out[k].turns] == want
    assert out[11].unmapped and out[98].unmapped == out[99].unmapped == "no JSON" and out[0].unmapped is None
    assert len({chat.fingerprint(set(m.shape)) for m in chat.LAYOUTS}) == len(chat.LAYOUTS)


def test_long_conversation_and_ties(spark):
    turns = [(7, k // 2, "user" if k % 2 else "assistant", f"t{k}") for k in range(500)] + [(8, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in chat.to_turns(chat.to_records(df)).collect()}
    assert [t.text for t in out[7].turns] == [f"t{k}" for k in range(500)] and [(t.role, t.text) for t in out[8].turns] == [("", "")]
    assert chat.to_records(df.where("false")).count() == 0


# --- 8: near duplicates --------------------------------------------------------------------------------------


def test_simhash_query_and_odd_texts(spark):
    docs = real("documents", "doc_id, text")
    assert rows(queries.QUERIES["op8_simhash"](spark, SF)) == sorted(simhash.brute_force(docs), key=repr)
    got = sorted((r.doc_id, f"{r._fp & (2**64 - 1):016x}", r._component) for r in simhash.near_duplicates(documents(spark)).collect())
    assert got == sorted(simhash.brute_force(TEXTS))
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("pairs", [48, 2])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, pairs):
    monkeypatch.setattr(simhash, "LIST_PAIRS", pairs)
    rnd = random.Random(6)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    base = rnd.getrandbits(64)
    for _ in range(250):
        base ^= 1 << rnd.randrange(64)
        if rnd.random() < 0.5:
            base ^= 1 << rnd.randrange(64)
        if rnd.random() < 0.2:
            base ^= 1 << rnd.randrange(64)
        fps.add(base)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "_fp bigint")
    found = {r.node: r.root for r in components(simhash.links(df)).collect()}
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    own = {x: found.get(simhash._signed(x), simhash._signed(x)) for x in fps}
    assert len({(root(x), own[x]) for x in fps}) == len({root(x) for x in fps}) == len(set(own.values()))


def test_every_two_bytes_are_left_out_together():
    from itertools import combinations

    assert all(any(set(p) <= set(f) for f in simhash.FREE) for p in combinations(range(8), 2))


def test_long_chains_settle_or_raise(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(5, 5), (8, 7)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in components(edges).collect() if r.node} == {(k, 0) for k in range(1, 301)}
    with pytest.raises(RuntimeError):
        components(edges, max_rounds=2)


def test_one_of_each_group_stays(spark):
    d = documents(spark)
    out = simhash.drop_near_duplicates(d)
    want = {c for _, _, c in simhash.brute_force(TEXTS)}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want) and out.columns == d.columns


# --- 9: pseudonyms -------------------------------------------------------------------------------------------


KEY = b"test key"


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("card", "4111 1111-1111 1111"), ("card", "4485180114407329"[:15] + pseudonyms.luhn_digit("448518011440732")), ("ssn", "123-45-6789"), ("ip", "10.0.0.255"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"),
        ("date", "2024-02-29"), ("date", "31.12.1999"), ("date", "12/31/1999"), ("email", "Jo.doe+7@mail.example.com"), ("phone", "+1 (017) 555-7713"), ("phone", "555-123-4567"),
    ],
)
def test_formats_are_kept_and_values_linked(kind, text):
    new, kinds = pseudonyms.pseudonymise(KEY, f"x {text}, then {text}.")
    a, b = new[2:].split(", then ")
    assert kinds == [kind, kind] and a == b[:-1] != text
    if kind != "ip":
        assert len(a) == len(text) and [c.isdigit() for c in a] == [c.isdigit() for c in text]
    again, kinds2 = pseudonyms.pseudonymise(KEY, a)
    assert kinds2 == [kind]
    assert pseudonyms.pseudonymise(b"other", text)[0] != a


@pytest.mark.parametrize("text", ["4111111111111112", "666-12-3456", "300.1.1.1", "DE00 3704 0044 0532 0130 00", "2024-02-30", "31/31/1999", "a@b", "no digits", "", "version 1.2.3.4.5", "id 12345"])
def test_what_fails_its_checks_stays(text):
    assert pseudonyms.pseudonymise(KEY, text) == (text, [])


def test_permutations():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pseudonyms.permute(KEY, "t", x, size) for x in range(size)) == list(range(size))


@pytest.mark.parametrize(("text", "kinds"), [("4111111111111111 12/27", ["card"]), ("on 31/12/2020 and 12/31/2020", ["date", "date"]), ("4111111111111112 12", [])])
def test_values_beside_digits_and_day_first_dates(text, kinds):
    new, found = pseudonyms.pseudonymise(KEY, text)
    assert found == kinds and (new != text) == bool(kinds) and pseudonyms.restore(KEY, new) == text


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain_values(text: str) -> dict[str, list[str]]:
    """Values found by splitting at blanks, without the operator's patterns."""
    import calendar

    out: dict[str, list[str]] = {"email": [], "ssn": [], "ip": [], "date": []}
    for w in text.split():
        w = w.strip(".,;:!?()[]\"'<>")
        p = w.split("-")
        if w.isascii() and [len(x) for x in p] == [3, 2, 4] and all(x.isdigit() for x in p) and 0 < int(p[0]) < 900 and p[0] != "666" and int(p[1]) and int(p[2]):
            out["ssn"].append(w)
        if w.isascii() and [len(x) for x in p] == [4, 2, 2] and all(x.isdigit() for x in p) and 1900 <= int(p[0]) < 2100 and 1 <= int(p[1]) <= 12 and 1 <= int(p[2]) <= calendar.monthrange(int(p[0]), int(p[1]))[1]:
            out["date"].append(w)
        q = w.split(".")
        if w.isascii() and len(q) == 4 and all(x.isdigit() and str(int(x)) == x and int(x) < 256 for x in q):
            out["ip"].append(w)
        if w.isascii() and w.count("@") == 1 and (local := w.split("@")[0]).replace(".", "").isalnum() and "." in w.split("@")[1] and local[0].isalnum() and w.split("@")[1].replace(".", "").isalpha():
            out["email"].append(w)
    return out


def test_pseudonym_query_against_plain_search_and_round_trip(spark):
    docs = dict(real("documents", "doc_id, text"))
    key = pseudonyms.TEST_KEY.encode()
    links: dict[tuple, set] = {}
    found = 0
    for r in queries.QUERIES["op9_pseudonyms"](spark, SF).collect():
        assert pseudonyms.restore(key, r.text) == docs[r.doc_id] and (r.n_replaced > 0) == (r.text != docs[r.doc_id])
        before, after = plain_values(docs[r.doc_id]), plain_values(r.text)
        for kind, values in before.items():
            assert len(values) == len(after[kind]) <= r[f"n_{kind}"]
            for x, y in zip(values, after[kind]):
                links.setdefault((kind, x), set()).add(y)
                found += 1
    assert found and all(len(ys) == 1 for ys in links.values()) and len({(k, *ys) for (k, _), ys in links.items()}) == len(links)
    assert sum({x} == ys for (_, x), ys in links.items()) <= 0.05 * len(links)


def test_pseudonyms_of_odd_rows(spark):
    d = documents(spark, [*TEXTS, (50, "call 555-123-4567 " * 2000), (50, "call 555-123-4567 " * 2000)])
    out = pseudonyms.with_pseudonyms(d, KEY, keep=("doc_id", "value", "_pn_text", "keep"))
    assert out.columns == ["doc_id", "value", "keep", "_pn_text", "_pn_kinds"]
    got = out.collect()
    assert len(got) == d.count() and {r.doc_id: r._pn_text for r in got}[1] is None
    assert len({r._pn_text for r in got if r.doc_id == 50}) == 1 and all(len(r._pn_kinds) == 2000 for r in got if r.doc_id == 50)
    assert pseudonyms.with_pseudonyms(empty(spark), KEY).count() == 0
    with pytest.raises(ValueError):
        pseudonyms.with_pseudonyms(d, b"")


# --- shared --------------------------------------------------------------------------------------------------


def test_stored_frames_come_back(spark):
    d = documents(spark)
    assert stored(spark, d, "test").count() == d.count()
