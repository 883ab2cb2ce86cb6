"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import chat_format, embedding_dedup, language_id, mixing, near_dedup, packing, secret_scan, substring_dedup, topk_search, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_chat_format": chat_format.op10_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.OP2_SQL,
    "op8_embedding_dedup": embedding_dedup.OP8_SQL,
    "op9_topk_search": topk_search.OP9_SQL,
    "op10_chat_format": chat_format.OP10_SQL,
}
