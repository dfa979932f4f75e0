"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkloom.llm import chat, fixity, langid, manifest, minhash, mixing, negatives, pieces, quality, sharding, simhash, substrings, wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (chat.op1_chat_prefix_tree, mixing.op2_mix_sources, substrings.op3_substring_dedup, pieces.op4_sentencepiece, sharding.op5_shard_documents, minhash.op6_document_fingerprints, simhash.op7_simhash_near_dedup, fixity.op8_warc_fixity, quality.op9_quality_rules, wrappers.op10_html_wrappers, langid.op11_language_id, negatives.op12_hard_negatives, manifest.op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc_fixity": fixity.OP8_SQL, "op12_hard_negatives": negatives.OP12_SQL, "op13_merkle_manifest": manifest.op13_sql()}
