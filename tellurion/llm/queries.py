"""The training-data queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, linededup, piece_bpe, pseudonyms, quality, repair, simhash, spelling, token_orc, toxicity, versions, warc_index

QUERIES = {
    "op1_warc": warc_index.op1_warc,
    "op2_quality": quality.op2_quality,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_piece_bpe": piece_bpe.op5_piece_bpe,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat": chat.op7_chat,
    "op8_simhash": simhash.op8_simhash,
    "op9_pseudonyms": pseudonyms.op9_pseudonyms,
    "op10_token_orc": token_orc.op10_token_orc,
    "op11_versions": versions.op11_versions,
    "op12_spelling": spelling.op12_spelling,
    "op13_repair": repair.op13_repair,
}

SQL = {
    "op2_quality": quality.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op4_line_dedup": linededup.SQL,
    "op7_chat": chat.SQL,
    "op12_spelling": spelling.SQL,
    "op13_repair": repair.SQL,
}
