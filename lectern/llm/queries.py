"""The opN_ queries of this subpackage and, where SQL can express one on whole tables, its DuckDB SQL."""

from __future__ import annotations

from . import chat, decontaminate, divergence, infill, jaccard, lines, matroska, mixing, pii, secrets, simhash, sql_queries, token_counts, toxicity


def queries():
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_chat_formatting": chat.op2_chat_formatting,
        "op3_pii": pii.op3_pii,
        "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
        "op5_secrets": secrets.op5_secrets,
        "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_matroska": matroska.op9_matroska,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_divergence": divergence.op11_divergence,
        "op12_simhash": simhash.op12_simhash,
        "op13_infill": infill.op13_infill,
        **sql_queries.QUERIES,
    }


def oracle_sql():
    return sql_queries.SQL | {"op11_divergence": divergence.SQL, "op13_infill": infill.SQL}
