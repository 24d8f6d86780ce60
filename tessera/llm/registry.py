"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import ann, bpe, chat, jaccard, lm, mixing, quality, repeats, secrets, toxicity

QUERIES = {
    "op1_lm": lm.op1_lm,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_ann": ann.op7_ann,
    "op8_chat": chat.op8_chat,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_bpe": bpe.op4_bpe,
    "op5_secrets": secrets.op5_secrets,
    "op10_repeats": repeats.op10_repeats,
    "op9_quality": quality.op9_quality,
}
#: DuckDB SQL of those that SQL can express.
ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.SQL}
