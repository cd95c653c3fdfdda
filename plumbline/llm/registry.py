"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import byte_bpe, chat, decontaminate, minhash, quality, secrets, sharding, substring, token_files, url_filter


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_minimax": sharding.op1_shard_minimax,
    "op2_secret_links": secrets.op2_secret_links,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_url_list_asof": url_filter.op4_url_list_asof,
    "op5_substring_windows": substring.op5_substring_windows,
    "op6_chat_fingerprint": chat.op6_chat_fingerprint,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_minhash": minhash.op8_minhash,
    "op9_token_files": token_files.op9_token_files,
    "op10_quality": quality.op10_quality,
    "pipeline": _pipeline,
}
ORACLES: dict[str, str] = {
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_url_list_asof": url_filter.OP4_SQL,
    "op6_chat_fingerprint": chat.OP6_SQL,
}
