"""The registered queries of the llm operators and their DuckDB SQL."""

from __future__ import annotations

from helixspark.llm import bpe, exact_dedup, mixing, near_dedup, pii, quality_lm, quality_rules, toxicity, url_filter, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_pii": pii.op3_pii,
    "op4_bpe": bpe.op4_bpe,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_minhash": near_dedup.op7_minhash,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality_lm": quality_lm.op9_quality_lm,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_url_filter": url_filter.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
}
