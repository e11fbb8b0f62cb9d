"""Queries of the training-data operators: name -> callable, and their DuckDB SQL."""

from __future__ import annotations

from . import chat, exact_dedup, log_bilinear, mixing, packing, quality, schema_rewrite, sharding, simhash, sort_means, token_count, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc": warc.query,
        "op2_chat_formatting": chat.query,
        "op3_simhash_near_dedup": simhash.query,
        "op4_packing": packing.query,
        "op5_resharding": sharding.query,
        "op6_mixing": mixing.query,
        "op7_quality_rules": quality.query,
        "op8_toxicity": toxicity.query,
        "op9_token_counts": token_count.query,
        "op10_exact_dedup": exact_dedup.query,
        "op11_sort_means": sort_means.query,
        "op12_schema_rewrite": schema_rewrite.query,
        "op13_log_bilinear": log_bilinear.query,
    }


def oracle_sql() -> dict:
    return {"op1_warc": warc.SQL, "op2_chat_formatting": chat.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_sort_means": sort_means.SQL}
