"""Exact neighbours over a whole table against all pairs."""

from __future__ import annotations

import numpy as np

from tellurion.operators import usage as U

from .oracle import SF


def test_nearest_over_the_whole_table_leaves_out_only_the_own_row(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    ids, vectors = zip(*((r.vec_id, r.embedding) for r in e.collect()))
    m = np.array(vectors, dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in U.nearest(e.where("vec_id % 20 = 0"), e, 10).collect():
        got.setdefault(r.query_id, []).append((r.place, r.corpus_id))
    ids = np.array(ids)
    assert len(got) == sum(ids % 20 == 0)
    for q, found in got.items():
        cos = np.where(ids == q, -2, m @ m[ids == q][0])
        assert [i for _, i in sorted(found)] == ids[np.lexsort((ids, -cos))[:10]].tolist()


def test_nearest_skips_far_cells_and_keeps_ties_zeros_and_crowds(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, 8)) * 5
    points = [(i, (centres[i % 6] + rnd.normal(size=8) * 0.2).tolist()) for i in range(900)]
    points += [(1000 + i, centres[0].tolist()) for i in range(400)]  # a crowd of copies
    points += [(2000, [0.0] * 8), (2001, None), (2002, [-x for x in points[0][1]])]
    monkeypatch.setattr(U, "PIVOT_ROWS", 20)
    c = spark.createDataFrame(points, "vec_id bigint, embedding array<double>").repartition(5)
    q = c.where("vec_id % 20 = 0 OR vec_id >= 2000")
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in points if v is not None}
    ids = np.array(sorted(unit))
    m = np.stack([unit[i] for i in ids])
    for size in (7, 4096):
        got: dict = {}
        for r in U.nearest(q, c, 5, block=size, corpus_block=size * 10).collect():
            got.setdefault(r.query_id, []).append((r.place, r.corpus_id))
        assert got.keys() == {i for i in unit if i % 20 == 0 or i >= 2000}
        for i, found in got.items():
            cos = np.round(m @ unit[i], 12)
            want = [j for j in ids[np.lexsort((ids, -cos))] if j != i][:5]
            assert [j for _, j in sorted(found)] == want
    r = U.skipped_pairs(q, c, 5).first()
    assert 0 < r.computed < r.pairs / 2
    assert U.nearest(q, c.where("false"), 5).count() == 0 and U.nearest(q.where("false"), c, 5).count() == 0
