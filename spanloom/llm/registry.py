"""Queries of the operators over their whole tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (chat, decontaminate, importance, language, mixing, neardup_text, neardup_vectors, pages, passages, shards, substrings,
               token_files, whitening)
from .base import table


def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through token files, with the tokenizer file of the installed package."""
    import public_tokenizers

    return token_files.token_files_query(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def over(name: str, fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardup": over("embeddings", neardup_vectors.near_dups),
    "op2_chat_formatting": over("conversations", chat.chats_query),
    "op3_html_extraction": over("pages", pages.pages_query),
    "op4_sharding": over("documents", shards.shards_query),
    "op5_minhash_neardup": over("documents", neardup_text.near_dups_query),
    "op6_decontamination": lambda spark, sf_dir: decontaminate.decontamination_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op7_substring_bytes": over("documents", substrings.substrings_query),
    "op8_language_id": over("documents", language.language_query),
    "op9_substring_words": over("documents", passages.passages_query),
    "op10_mixing": over("documents", mixing.mixing_query),
    "op11_whitening": over("embeddings", whitening.whitening_query),
    "op12_importance": lambda spark, sf_dir: importance.importance_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op13_token_files": token_files_query,
}

#: queries whose narrow tables of ids pack so well that joins go by measured rows alone (``session.JOINS``)
MEASURED = {"op1_embedding_neardup"}

ORACLES: dict[str, str] = {
    "op1_embedding_neardup": neardup_vectors.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op9_substring_words": passages.ORACLE,
    "op12_importance": importance.ORACLE,
}
