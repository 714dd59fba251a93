"""Versions, spelling variants and conversation repair: brute force, odd rows and hot groups."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.llm import linededup, queries, repair, spelling, toxicity, versions

from ..oracle import SF
from .helpers import EXTRA, TEXTS, documents, empty, real, rows

# --- 11: versions --------------------------------------------------------------------------------------------

NUMBERS = ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")


def test_versions_query(spark):
    got = queries.QUERIES["op11_versions"](spark, SF)
    assert rows(got.select(*NUMBERS)) == sorted(versions.brute_force(real("documents", "doc_id, text")), key=repr)


def test_versions_do_not_depend_on_the_ranges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        found = rows(versions.beside_next(docs).select(*NUMBERS))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found == sorted(versions.brute_force(real("documents", "doc_id, text")), key=repr)


def test_versions_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(versions, "SLICE", 1000)
    unique = dict(TEXTS)
    found = versions.beside_next(documents(spark, list(unique.items())))
    assert rows(found.select(*NUMBERS)) == sorted(versions.brute_force(list(unique.items())), key=repr)
    assert {"source", "a.b c", "keep"} <= set(found.columns)
    twice = versions.beside_next(documents(spark)).collect()
    assert len(twice) == len(TEXTS)
    assert len({r.fingerprint for r in twice if r.doc_id == 13}) == 1
    assert max(r.near_next for r in twice if r.doc_id == 13) == 1.0
    assert versions.beside_next(empty(spark)).count() == 0
    assert versions.fingerprints(empty(spark)).count() == 0
    one = versions.beside_next(spark.createDataFrame([(7, "only. one")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"only.only").hexdigest()


def test_equal_ids_texts_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a.b"), (None, None), (1, "x.y"), (1, "x.z"), (1, "x.y")], "doc_id bigint, text string")
    found = versions.beside_next(docs)
    assert found.count() == 5
    assert rows(found.groupBy("doc_id").count()) == sorted([(None, 2), (1, 3)], key=repr)
    by_name = docs.select(F.col("doc_id").cast("string"), "text")
    assert versions.beside_next(by_name).count() == 5


def test_changes_recover_digests(spark):
    """Versions of some paragraphs, with a sketch too small for many changes."""
    rng = random.Random(5)
    lines = [f"line {k} {rng.randrange(10**9)}" for k in range(4000)]
    old = [(k, "\n".join(lines[: 40 * k])) for k in range(1, 60)]
    new = [(k, "\n".join([*lines[3 * k : 40 * k], *(f"new {j}" for j in range(k)), lines[-1], lines[-1]])) for k, _ in old]
    frame = lambda x: spark.createDataFrame(x, "doc_id bigint, text string")
    for r in versions.changes(frame(old), frame(new)).collect():
        assert (len(r.removed), len(r.added)) == (3 * r.doc_id, r.doc_id + 2)
        union = 40 * r.doc_id + r.doc_id + 2
        assert r.likeness == pytest.approx(37 * r.doc_id / union)
        assert r.cells >= len(r.removed) + len(r.added) - 1
        assert len(set(r.removed)) == len(r.removed) and len(set(r.added)) == len(r.added)
    assert versions.changes(frame(old), frame(old)).where("likeness < 1 or cells <> 18").count() == 0


def test_sketches_are_linear():
    sets = versions.Sets(["a\nb\nc", "c\nb\na\n"])
    x = versions.sketched(sets, np.array([0, 1]))
    assert len(set(x.texts())) == 1


def test_long_paragraphs_keep_their_cuts():
    words = [f"w{k}" for k in range(400)]
    a, b = versions.paragraphs(" ".join(words)), versions.paragraphs(" ".join(["new", *words]))
    assert len(a) > 5 and len(set(a) & set(b)) >= len(a) - 1


# --- 12: spelling variants -----------------------------------------------------------------------------------


def test_spelling_query_counts(spark):
    counts = spelling.brute_counts(real("documents", "doc_id, text"))
    assert dict(rows(spelling.count_words(spark.read.parquet(f"{SF}/documents.parquet")))) == counts


def words_table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint").selectExpr("*", "1 AS key", "2 AS id", "'x' AS form", "3 AS size", "4 AS last")


WORDS = {"a": 1000, "ab": 10, "b": 3, "abc": 1, "abcd": 1, "abcde": 20, "abde": 2, "abdde": 200, "été": 5, "ête": 50, "aaaaaaaa": 4, "aaaaaaa": 40, "aaaaaaab": 4, "baaaaaaa": 400, "abababab": 7, "babababab": 7, "漢字仮名": 3, "漢字仮名交": 30, "🙂🙃🙂🙃🙂": 1, "🙂🙃🙂🙂🙂": 10}
WORDS |= {"x" * 63: 2, "x" * 64: 20, "x" * 65: 200, "x" * 66: 2000, "x" * 64 + "y": 5, "y" * 3000: 1, "y" * 2999: 10, "y" * 1500 + "z" + "y" * 1499: 3}


def test_odd_words(spark):
    want = sorted(spelling.brute_force(WORDS), key=repr)
    assert rows(spelling.group_variants(words_table(spark, WORDS))) == want
    halves = words_table(spark, {w: n for w, n in WORDS.items() if n % 2 == 0}).selectExpr("word", "n div 2 AS n")
    rest = words_table(spark, {w: n for w, n in WORDS.items() if n % 2}).select("word", "n")
    assert rows(spelling.group_variants(halves.unionByName(halves).unionByName(rest).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS word, 1L AS n")))) == want
    assert spelling.group_variants(words_table(spark, WORDS).where("false")).count() == 0


@pytest.mark.parametrize("most", [0, 3, 64])
def test_crowded_lists(spark, monkeypatch, most):
    """Words of few letters share most bigrams; every route gives the pairs of a comparison of all."""
    monkeypatch.setattr(spelling, "LIST_PAIRS", most)
    rng = random.Random(1)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 8))): rng.choice([1, 2, 30, 400]) for _ in range(500)}
    assert rows(spelling.group_variants(words_table(spark, counts))) == sorted(spelling.brute_force(counts), key=repr)


def test_chains_lead_to_their_end(spark):
    counts = {"aaaabbbb": 2, "aaaabbbc": 20, "aaaabbcc": 200, "aaaabccc": 2000, "aaaacccc": 20000}
    found = {r.word: (r.form, r.root) for r in spelling.group_variants(words_table(spark, counts)).collect()}
    assert found["aaaabbbb"] == ("aaaabbbc", "aaaacccc") and found["aaaacccc"] == (None, "aaaacccc")


def test_word_counts_of_odd_texts(spark):
    texts = [*TEXTS, (20, "Éclairage ÉCLAIRAGE éclairage x÷yyyyyyy ÀÀÀÀÀÀÀ \xc2\xb7 Straßenbahn straßenbahn Ĳabcdefg"), (21, "abcdefghij" * 9000), (None, "nobodies nobodies")] * 2
    assert dict(rows(spelling.count_words(documents(spark, [t for t in texts if t[0] is not None]).unionByName(documents(spark, [(0, "nobodies nobodies")] * 2).withColumn("doc_id", F.lit(None).cast("bigint")))))) == spelling.brute_counts(texts)
    assert spelling.count_words(empty(spark)).count() == 0


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(2)
    for _ in range(300):
        items = sorted(zip(rng.sample(range(8), 3), (rng.randint(1, 9) for _ in range(3))))
        a, b = spelling.pivots(items)
        cost = dict(items)
        assert b - a >= 2
        assert cost[a] + cost[b] == min(x + y for i, (p, x) in enumerate(items) for q, y in items[i + 1 :] if q - p >= 2)


# --- 13: conversation repair ---------------------------------------------------------------------------------


def conversations(spark, data):
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    return df.selectExpr("*", *(e for e in EXTRA.split(", ")), "7 AS at", "8 AS seg", "9 AS edits", "10 AS copies", "11 AS fault")


def repaired(df) -> list[tuple]:
    found = repair.repaired_conversations(df, df)
    return rows(found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def brute(data) -> list[tuple]:
    by: dict = {}
    for conv, turn, role, text in data:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return sorted(((c, *repair.brute_force(x)) for c, x in by.items()), key=repr)


def made(n: int, seed: int, longest: int = 12) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \t", "Why?", "on\n", None, "é!", *(f"t{k}." for k in range(6)), *(f"u{k}" for k in range(3))]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys"]
    return [(c if c else None, rng.choice([None, *range(8), 2**40]), rng.choice(roles), rng.choice(texts)) for c in range(n) for _ in range(rng.randint(1, longest))]


def test_repair_equals_brute_force(spark):
    data = made(150, 3)
    assert repaired(conversations(spark, data)) == brute(data)


def test_repair_of_pieces(spark):
    """A conversation of most rows lies in many ranges; repeated rows; runs of one symbol."""
    rng = random.Random(4)
    data = [(1, k, rng.choice(["user", "assistant", "tool"]), f"say {rng.choice(['x', k])}{rng.choice(['.', ''])}") for k in range(900)]
    data += [(2, 0, "user", "same.")] * 300 + [(3, k, "user", f"{k}.") for k in range(500)] + [(4, k, "assistant", f"{k}") for k in range(77)]
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert repair.placed(conversations(spark, data)).where("conv_id = 1").select("seg").distinct().count() > 3
        assert repaired(conversations(spark, data)) == brute(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edits_give_the_repaired_rows(spark):
    data = made(60, 9)
    edits, measures = repair.repair(conversations(spark, data))
    by: dict = {}
    for r in sorted(edits.collect(), key=lambda r: (r.at, r.k)):
        by.setdefault(r.conv_id, []).append(r)
    for m in measures.collect():
        own = by[m.conv_id]
        assert "".join(r.edit for r in own) == m.audit
        initials = "".join(r.role[:1] for r in own if r.edit != "D")
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2)


def test_damage_and_lost_conversations(spark):
    assert repaired(conversations(spark, []).where("false")) == []
    df = conversations(spark, [(k, 0, "user", "hello.") for k in range(200)])
    found = repair.repaired_conversations(df, repair.damage(df))
    assert found.count() == 200
    gone = found.where("audit = '' AND cost = 0 AND blank = 0").collect()
    assert gone and {r.repaired_sha256 for r in gone} == {hashlib.sha256().hexdigest()}


def test_runs_take_powers():
    """A run of very many rows takes as many products as its length has bits."""
    n = (1 << 40) + 12345
    one = repair.FINAL
    for _ in range(50):
        one = repair._applied(repair.power("u", 0), one)
    assert repair.before("u", 50, repair.FINAL) == one
    assert min(repair.before("u", n, repair.FINAL)) == n // 2 + 1  # every second row changes its role


# --- equal cosines, ids as text ------------------------------------------------------------------------------


def test_scores_do_not_depend_on_ids(spark):
    """Copies of a text with either label, and texts as near as the last neighbour: other ids, same scores."""
    rng = random.Random(6)
    pool = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    texts = [("same words here for all", k % 2) for k in range(80)] + [(f"other {rng.choice('abcdef')} text {rng.choice('ghij')}", int(rng.random() < 0.3)) for _ in range(60)]

    def scores(order: list[int]) -> dict[str, float]:
        docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(order, texts)], "doc_id bigint, text string")
        labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(order, texts)], "doc_id bigint, toxic int")
        found = toxicity.score_toxicity(docs, labels).collect()
        by = {i: t for i, (t, _) in zip(order, texts)}
        return {by[r.doc_id]: r._tx_score for r in found}

    first = scores(pool[: len(texts)])
    for _ in range(2):
        rng.shuffle(pool)
        again = scores(pool[: len(texts)])
        assert again.keys() == first.keys() and all(abs(again[t] - first[t]) < 1e-9 for t in first)
    assert 0.3 < first["same words here for all"] < 0.7


def test_line_dedup_takes_any_ids(spark):
    line = "a line that is long enough to count"
    docs = [(f"d{k}", f"{line}\nown {k}") for k in range(4)] + [("e", None)]
    found = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id string, text string"))
    assert {r.doc_id: r._ld_dropped for r in found.collect()} == {"d0": 1, "d1": 1, "d2": 1, "d3": 0, "e": 0}
