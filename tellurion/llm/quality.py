"""Quality rules on text, with cross-document line frequency. DataFrame functions only.

Base rules look at one document: words, symbols, repeated lines and words under repeated five-word windows. The
cross-document rule hashes normalised lines, counts for each host the distinct documents that hold a line, takes lines
above the limit (boilerplate of the host) out of the texts, and rejects documents that lose most of their words by it.

A line is above the limit where more than max(MIN_DOCS, SHARE x distinct documents of the host) documents hold it. The
share makes the rule behave alike at every size, and documents with equal texts count as one, so a copied document is
not boilerplate. A document is depleted when fewer than KEEP_SHARE of its words are left.

Scale: base rules are array expressions on each row, without a shuffle. For the line counts a row per distinct
(host, text) carries its line hashes; counts are pre-aggregated per task; the join back meets only lines above the
limit. Texts themselves are not shuffled for the verdicts. Both sides of the joins that a line of a whole host or the
copies of one text could make lopsided are plain shuffles, so that AQE splits them.

Defined cases: null text has no words and fails; null host is a host of its own; windows and lines of very long texts all
count; among equal lines the first is no repetition; repeated rows get the same verdict; an empty table gives an empty
result; the caller's columns travel in a struct of their own, so any names are safe, but where base_rules() or judged()
return a column of the caller's name, the caller's gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, packed, stored, table, unpacked

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_DOCS = 8
SHARE = 0.08
KEEP_SHARE = 0.3

BLANK = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def normalised(line: Column) -> Column:
    """Blanks collapsed and cut at the ends, A-Z lowered, runs of digits as one 0."""
    line = F.regexp_replace(F.regexp_replace(line, BLANK + "+", " "), "[0-9]+", "0")
    return F.trim(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


BASE = ("_q_words", "_q_chars", "_q_symbols", "_q_dup_lines", "_q_repeat", "_q_failed")


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with the columns BASE."""
    kept = others(docs.columns, BASE)
    return unpacked(_base(docs.select(packed(kept), F.coalesce("text", F.lit("")).alias("text"))), kept, *BASE)


def _base(rows: DataFrame) -> DataFrame:
    """rows (with a text that is not null) and the columns BASE."""
    one = rows.withColumn("_q_w", words(F.col("text"))).withColumn("_q_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windows = F.expr(
        f"if(size(_q_w) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(_q_w) - {WINDOW}), i -> xxhash64({', '.join(f'_q_w[i + {k}]' for k in range(WINDOW))})))"
    )
    two = one.select(
        *rows.columns, F.size("_q_w").cast("long").alias("_q_words"), F.length(F.array_join("_q_w", "")).cast("long").alias("_q_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("_q_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_dup_lines"), windows.alias("_q_win"),
    )
    # only where some window is repeated: windows in order of hash, positions of those equal to a neighbour
    sorted_ = F.expr("if(size(_q_win) = size(array_distinct(_q_win)), null, array_sort(transform(_q_win, (w, i) -> struct(w, i))))")
    three = two.withColumn("_q_s", sorted_).drop("_q_win")
    at = F.expr(
        "array_sort(array_distinct(flatten(filter(zip_with(_q_s, slice(_q_s, 2, size(_q_s)), (a, b) -> if(a.w = b.w, array(a.i, b.i), null)), x -> x is not null))))"
    )
    four = three.withColumn("_q_at", F.when(F.col("_q_s").isNotNull(), at)).drop("_q_s")
    covered = F.expr(f"aggregate(_q_at, struct(-{WINDOW} as last, 0L as n), (a, p) -> struct(p as last, a.n + least({WINDOW}, p - a.last) as n), a -> a.n)")
    five = four.withColumn("_q_repeat", F.coalesce(covered, F.lit(0).cast("long"))).drop("_q_at")
    return five.withColumn("_q_failed", (F.col("_q_words") < MIN_WORDS) | (100 * F.col("_q_repeat") > MAX_REPEAT_PERCENT * F.col("_q_words")))


def _keys(host: str) -> list[Column]:
    return [F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_q_host"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_q_md5")]


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """For each distinct (host, text) that has lines above the limit: _q_host, _q_md5, _q_bad (their hashes), _q_gone (words in them)."""
    spark = docs.sparkSession
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = F.transform("_q_lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(words(x)).alias("n")))
    texts = docs.select(*_keys(host), lines.alias("_q_lines")).select("_q_host", "_q_md5", hashed.alias("_q_lines"))
    texts = stored(spark, texts.dropDuplicates(["_q_host", "_q_md5"]), "quality-lines")
    sizes = texts.groupBy("_q_host").agg(F.count("*").alias("_q_docs"))
    once = texts.select("_q_host", F.explode(F.array_distinct("_q_lines.h")).alias("_q_h"))
    counts = once.groupBy("_q_host", "_q_h").agg(F.count("*").alias("_q_n")).where(F.col("_q_n") > min_docs)
    # hosts are few against lines, and only lines above the absolute limit are left to compare
    bad = stored(spark, counts.join(sizes, "_q_host").where(F.col("_q_n") > share * F.col("_q_docs")).select("_q_host", "_q_h"), "quality-bad")
    each = texts.select("_q_host", "_q_md5", F.explode("_q_lines").alias("_q_x")).select("_q_host", "_q_md5", F.col("_q_x.h").alias("_q_h"), F.col("_q_x.n").alias("_q_c"))
    hits = each.join(bad, ["_q_host", "_q_h"], "left_semi")
    found = hits.groupBy("_q_host", "_q_md5").agg(F.collect_set("_q_h").alias("_q_bad"), F.sum("_q_c").alias("_q_gone"))
    return stored(spark, found, "quality-hits")


def _judged(docs: DataFrame, kept: list[str], host: str, text: bool, min_docs: int, share: float, keep_share: float) -> DataFrame:
    """keep, the columns BASE, _q_gone, _q_kept and, with text, the text without the lines above the limit."""
    base = _base(docs.select(packed(kept), F.coalesce("text", F.lit("")).alias("text"), *_keys(host)))
    base = base if text else base.drop("text")
    joined = base.join(frequent_lines(docs, host, min_docs, share), ["_q_host", "_q_md5"], "left").withColumn("_q_gone", F.coalesce("_q_gone", F.lit(0)))
    # one comparison over both sides of the join: as a conjunction, its base part would be pushed below the array steps
    # with their definitions written into one another, which is quadratic in a text's length
    lost = F.col("_q_gone") + F.when(F.col("_q_failed"), F.col("_q_words") + 1).otherwise(0)
    joined = joined.withColumn("_q_kept", F.col("_q_words") - lost >= keep_share * F.col("_q_words"))
    if text:
        left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_q_bad", F.xxhash64(normalised(x))) | ~x.rlike(r"[^\x20\x09-\x0D]"))
        joined = joined.withColumn("text", F.when(F.col("_q_bad").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text")))
    return joined


def judged(docs: DataFrame, host: str = "source", text: bool = True, min_docs: int = MIN_DOCS, share: float = SHARE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """docs with the columns BASE, _q_gone and _q_kept; with text, their text (null as empty) is without the lines above the limit."""
    own = (*BASE, "_q_gone", "_q_kept", *["text"] * text)
    kept = others(docs.columns, (*own, "text"))
    return unpacked(_judged(docs, kept, host, text, min_docs, share, keep_share), kept, *own)


def filter_quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass, without the lines above the limit; n_chars follows the text."""
    rest = [c for c in docs.columns if c != "text"]
    found = _judged(docs, rest, host, True, MIN_DOCS, SHARE, KEEP_SHARE).where("_q_kept")
    new = {"text": F.col("text")}
    if "n_chars" in rest:
        new["n_chars"] = F.when(F.col("_q_gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("keep.n_chars"))
    return found.select(*(new.get(c, F.col(f"keep.`{c}`")).alias(c) for c in docs.columns))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), text=False)
    return found.select(
        "doc_id", F.col("_q_words").alias("n_words"), F.col("_q_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"), F.col("_q_dup_lines").alias("n_dup_lines"),
        F.col("_q_repeat").alias("n_repeat_words"), F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"),
    )


SQL = rf"""
WITH doc AS (SELECT doc_id, coalesce(source, '') || CASE WHEN source IS NULL THEN chr(1) ELSE '' END AS host, coalesce(text, '') AS text FROM documents),
wd AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM doc),
win AS (SELECT doc_id, k, w[k:k + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM wd WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
line AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM doc),
full_line AS (SELECT *, trim(translate(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') AS norm,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_line GROUP BY doc_id),
size AS (SELECT host, count(DISTINCT text) AS docs FROM doc GROUP BY host),
bad AS (SELECT f.host, norm FROM full_line f JOIN size USING (host) GROUP BY f.host, norm, docs HAVING count(DISTINCT text) > {MIN_DOCS} AND count(DISTINCT text) > {SHARE} * docs),
gone AS (SELECT doc_id, sum(n) AS n FROM full_line JOIN bad USING (host, norm) GROUP BY doc_id),
stat AS (SELECT wd.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone FROM wd LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND n_words - gone >= {KEEP_SHARE} * n_words AS kept
FROM stat
"""
