"""The operators' queries, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, html_text, leaks, mixing, quality, sharding, simhash, spelling, toxicity, url_filter, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_bpe": bpe.op3_bpe,
    "op4_chat": chat.op4_chat,
    "op5_simhash": simhash.op5_simhash,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_html_text": html_text.op7_html_text,
    "op8_sharding": sharding.op8_sharding,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_quality": quality.op10_quality,
    "op11_leaks": leaks.op11_leaks,
    "op12_spelling": spelling.op12_spelling,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {"op1_mixing": mixing.OP1_SQL, "op4_chat": chat.OP4_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op9_url_filter": url_filter.OP9_SQL, "op11_leaks": leaks.OP11_SQL, "op12_spelling": spelling.OP12_SQL}
