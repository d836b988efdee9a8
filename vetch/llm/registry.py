"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import centroids, exact_dedup, filter_audit, jaccard_join, line_dedup, lm, mixing, pieces, quality, secrets, simhash_dedup, substring_dedup, syncmers


def queries():
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_secrets": secrets.op2_secrets,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_syncmers": syncmers.op4_syncmers,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_simhash": simhash_dedup.op7_simhash,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_quality": quality.op9_quality,
        "op10_lm": lm.op10_lm,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_jaccard_join": jaccard_join.op12_jaccard_join,
        "op13_centroids": centroids.op13_centroids,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op1_mixing": mixing.ORACLE_OP1,
        "op2_secrets": secrets.ORACLE_OP2,
        "op3_exact_dedup": exact_dedup.ORACLE_OP3,
        "op11_filter_audit": filter_audit.ORACLE_OP11,
        "op12_jaccard_join": jaccard_join.ORACLE_OP12,
        "op13_centroids": centroids.ORACLE_OP13,
    }
