"""The pipeline against its stages' brute-force versions, one after the other."""

from __future__ import annotations

import hashlib
from array import array

import pytest

from tellurion.llm import decontaminate, linededup, piece_bpe

from ..oracle import SF, connect
from .helpers import documents, real
from .test_minhash import components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def expected() -> list[tuple]:
    import duckdb  # noqa: F401
    import sentencepiece

    from tellurion.llm import quality

    con = connect()
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    docs = dict(real("documents", "doc_id, text"))
    sources = dict(real("documents", "doc_id, source"))
    # boilerplate lines, read literally
    import re

    def norm(line: str) -> str:
        s = re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line)).strip(" ")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    holders: dict[tuple, set] = {}
    hosts: dict[str, set] = {}
    for i, t in docs.items():
        hosts.setdefault(sources[i], set()).add(t)
        for line in t.split("\n"):
            if line.encode().split():
                holders.setdefault((sources[i], norm(line)), set()).add(t)
    bad = {k for k, ts in holders.items() if len(ts) > quality.MIN_DOCS and len(ts) > quality.SHARE * len(hosts[k[0]])}
    rows = {i: "\n".join(x for x in docs[i].split("\n") if (sources[i], norm(x)) not in bad or not x.encode().split()) for i in kept}
    # repeated lines
    held: dict[bytes, set] = {}
    for i, t in rows.items():
        for x in t.encode().split(b"\n"):
            if len(linededup.key_of(x).decode()) >= linededup.MIN_CHARS:
                held.setdefault(linededup.key_of(x), set()).add(i)
    rows = {i: b"\n".join(x for x in t.encode().split(b"\n") if len(ids := held.get(linededup.key_of(x), ())) < linededup.MIN_DOCS or max(ids) == i).decode() for i, t in rows.items()}
    # near duplicates
    rows = {c: rows[c] for c in set(components(list(rows.items())).values())}
    # benchmark passages
    grams: set[tuple] = set()
    for _, t in real("benchmark", "item_id, text"):
        w = decontaminate.words_of(t.encode())
        grams |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    out = {}
    for i, t in rows.items():
        w = decontaminate.words_of(t.encode())
        hit = {p for m in {len(g) for g in grams} for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in grams for p in range(k, k + m)}
        if len(hit) > 0.5 * len(w):
            continue
        starts = sorted(p for p in hit if p - 1 not in hit)
        ends = sorted(p + 1 for p in hit if p + 1 not in hit)
        out[i] = decontaminate.remove_passages(t.encode(), starts, ends) if hit else t
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())
    return sorted((i, hashlib.sha256(array("I", lib.encode(t, add_bos=True, add_eos=True)).tobytes()).hexdigest()) for i, t in out.items())


def test_run_against_brute_force(spark):
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect())
    assert got == expected()


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
