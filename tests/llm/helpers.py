"""Small tables with nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""

from __future__ import annotations

import duckdb

from ..oracle import SF

#: Columns that operators use inside, here as the caller's own.
EXTRA = "'mine' AS n_words, 1 AS words, 2 AS lines, 'h' AS digest, 3 AS part, 4 AS ids, 5 AS items, 6 AS starts, 7 AS t, 8 AS key, 9 AS n, 10 AS turns, 11 AS record, 12 AS value"
#: The same for names that only their inner tables and results have.
EXTRA += "".join(f", {k} AS `{n}`" for k, n in enumerate("keep row set size bytes drop root least node hits clean ends unmapped centres own rest counts terms score rows last hot id at _fp _component _keep _least _q_host _q_md5 _q_words _q_text _q_bad _q_gone _q_kept _ld_raw _ld_text _ld_key _ld_drop _dc_text _dc_row _dc_clean _pb_text n_tokens _tx_text _tx_terms _tx_score _pn_raw _pn_text _ch_record _payload _first _digest".split()))
EXTRA += ", 1 AS `a.b c`"

TEXTS = [
    (1, None), (2, ""), (3, " \n\t\n "), (4, "one"), (5, "The quick brown fox jumps over the lazy dog near the old river bank today.\nshort\nThe quick brown fox jumps over the lazy dog near the old river bank today."),
    (6, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG NEAR THE OLD RIVER BANK TODAY.  \nanother line that is only here, number 6"), (7, "the quick brown fox jumps over the lazy dog near the old river bank today.\n\n\nend"),
    (8, "été à Ñandú 漢字 🙂 " * 40), (9, "été à Ñandú 漢字 🙂 " * 40), (10, "word " * 30_000), (11, "a b c\x00d\x0be <|im_start|> ▁▁x  y   z\r\n"), (12, " ".join(f"w{k}" for k in range(20_000))),
    (13, " ".join(f"v{k}" for k in range(300))), (14, " ".join(f"v{k}" for k in range(299)) + " changed"), (13, " ".join(f"v{k}" for k in range(300))),
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en", None if i % 3 == 0 else f"src{i % 2}", len(t) if t is not None else None) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", *EXTRA.split(", "))


def empty(spark):
    return documents(spark).where("false")


def real(table: str, columns: str) -> list[tuple]:
    return duckdb.connect().sql(f"SELECT {columns} FROM '{SF}/{table}.parquet'").fetchall()


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)
