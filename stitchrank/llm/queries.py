"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stitchrank.llm import binary, bwt, conversations, decontaminate, dedup, jaccard, language_model, merkle, mixing, quality, sharding, substrings, urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_exact_dedup": dedup.op3_exact_dedup,
    "op4_quality": quality.op4_quality,
    "op5_language_model": language_model.op5_language_model,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_byte_dedup": bwt.op9_byte_dedup,
    "op10_binary_ids": binary.op10_binary_ids,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_url_filter": urls.op12_url_filter,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL, "op3_exact_dedup": dedup.OP3_SQL, "op8_sharding": sharding.OP8_SQL, "op11_conversation_repair": conversations.OP11_SQL, "op13_merkle": merkle.OP13_SQL,
}
