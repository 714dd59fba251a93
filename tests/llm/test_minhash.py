"""Near-duplicates of the pipeline against the similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tellurion.llm import minhash
from tellurion.llm.common import table

from ..oracle import SF
from .helpers import documents, empty, real

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def grams(text: str | None) -> set[tuple]:
    w = (text or "").lower().encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(docs: list[tuple]) -> dict:
    sets = [(i, grams(t)) for i, t in docs]
    least = {i: i for i, _ in docs}
    for i, a in sets:
        for j, b in sets:
            if i < j and len(a & b) >= 0.8 * len(a | b):
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = {k: new if v == old else v for k, v in least.items()}
    return least


def edited(rnd: random.Random, base: list[str], n: int) -> str:
    w = list(base)
    for at in rnd.sample(range(len(w)), n):
        w[at] = f"x{rnd.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("pairs", [48, 2])
def test_edited_copies_link_as_all_pairs_do(spark, monkeypatch, pairs):
    monkeypatch.setattr(minhash, "LIST_PAIRS", pairs)
    rnd = random.Random(8)
    docs = []
    for _ in range(40):
        base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        docs += [(len(docs) + k, edited(rnd, base, n)) for k, n in enumerate((0, 1, 2, 3, 12))]
    docs += [(900, None), (901, ""), (902, "One two"), (903, "one  TWO"), (904, "two one")]
    want = components(docs)
    got = {r.doc_id: r._component for r in minhash.near_duplicates(documents(spark, docs)).collect()}
    assert got == want and len(set(want.values())) < len(docs) / 2


def test_stage_drops_a_copy_with_two_words_changed(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    docs = documents(spark, [(k, edited(rnd, base, 0 if not k else 2)) for k in range(6)] + [(6, edited(rnd, base, 40))])
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 6] and out.columns == docs.columns
    assert corpus_pipeline.near_dedup(spark, empty(spark), "").count() == 0


def test_real_documents_link_as_all_pairs_do(spark):
    docs = real("documents", "doc_id, text")
    got = {r.doc_id: r._component for r in minhash.near_duplicates(table(spark, SF, "documents")).collect()}
    assert got == components(docs)


@pytest.mark.parametrize(("copies", "most"), [(150, 48), (400, 48), (150, 6)])
def test_crowded_lists_link_as_all_pairs_do(spark, monkeypatch, copies, most):
    """Copies of one template, three words of 200 changed in each: most pairs lie near the limit, all lists are long."""
    monkeypatch.setattr(minhash, "LIST_PAIRS", most)
    rnd = random.Random(copies)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    docs = [(k, edited(rnd, base, 3)) for k in range(copies)]
    want = components(docs)
    got = {r.doc_id: r._component for r in minhash.near_duplicates(documents(spark, docs)).collect()}
    sets = [(i, grams(t)) for i, t in docs]
    true = [(i, j) for i, a in sets for j, b in sets if i < j and len(a & b) >= 0.8 * len(a | b)]
    joined = sum(got[i] == got[j] for i, j in true)
    assert all(want[i] == want[j] for i in got for j in (got[i],)) and joined >= 0.97 * len(true)
    assert len(set(got.values())) - len(set(want.values())) <= 0.05 * copies


def test_parities_rule_out_no_pair_that_is_similar(spark):
    rnd = np.random.default_rng(11)
    rows = []
    for size in (1, 4, 5, 9, 45, 200, 3000):
        for _ in range(40):
            whole = rnd.integers(0, 2**63, size, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([whole, rnd.integers(0, 2**63, int(rnd.integers(0, size // 4 + 2)), dtype=np.uint64)])) for _ in range(2))
            both = len(np.intersect1d(a, b))
            sides = [(len(s), minhash.parities(s).tolist()) for s in (a, b)]
            rows.append((size, both / (len(a) + len(b) - both), *sides))
    side = "struct<size: int, parity: array<bigint>>"
    found = spark.createDataFrame(rows, f"n int, similarity double, x {side}, y {side}").select("n", "similarity", minhash._may_reach("x", "y").alias("may")).collect()
    similar = [r.may for r in found if r.similarity >= 0.8]
    unlike = [r.may for r in found if r.similarity < 0.75 and r.n == 200]
    assert similar and all(similar) and unlike and not any(unlike)


def test_parities_of_the_least_similar_sets(spark):
    """4 of 5 shingles: exactly the similarity, where rounding must not take the pair away."""
    items = np.array([3, 2**61, 2**62, 2**63, 2**63 + 2**62], dtype=np.uint64)
    row = [((4, minhash.parities(items[:4]).tolist()), (5, minhash.parities(items).tolist()))]
    side = "struct<size: int, parity: array<bigint>>"
    assert spark.createDataFrame(row, f"x {side}, y {side}").where(minhash._may_reach("x", "y")).count() == 1
