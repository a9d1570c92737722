"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from . import chat, mixing, ngram, pieces, pii, quality, simhash, tokenfile, vectors, wordpiece


def _over(table, report):
    return lambda spark, sf_dir: report(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES = {
    "op1_quality_rules": _over("documents", quality.quality_report),
    "op2_pii": _over("documents", pii.pii_report),
    "op3_lm_scores": _over("documents", ngram.lm_report),
    "op4_token_counts": _over("documents", wordpiece.token_counts),
    "op5_token_files": _over("documents", tokenfile.tokenfile_report),
    "op6_simhash": _over("documents", simhash.simhash_report),
    "op7_chat": _over("conversations", chat.chat_report),
    "op8_mixing": _over("documents", mixing.mixing_report),
    "op9_pieces": _over("documents", pieces.pieces_report),
    "op10_embedding_dedup": _over("embeddings", vectors.vector_report),
}
ORACLE_SQL = {"op1_quality_rules": quality.REPORT_SQL, "op7_chat": chat.REPORT_SQL}
