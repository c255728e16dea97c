"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, byte_repeats, exact_dedup, language_id, lm_scoring, media_ts, mixing, near_dedup, toxicity, word_repeats

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_byte_repeats": byte_repeats.op4_byte_repeats,
    "op5_language_id": language_id.op5_language_id,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_media_ts": media_ts.op7_media_ts,
    "op8_mixing": mixing.op8_mixing,
    "op9_word_repeats": word_repeats.op9_word_repeats,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

ORACLE_SQL = {
    "op3_lm_scoring": lm_scoring.OP3_SQL,
    "op4_byte_repeats": byte_repeats.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op9_word_repeats": word_repeats.OP9_SQL,
}
