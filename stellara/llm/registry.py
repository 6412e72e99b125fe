"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stellara.llm import bpe, hnsw, iblt, lines, mixing, quality, sharding, simhash, toxicity, wordpiece


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_iblt": iblt.op1,
        "op2_byte_bpe": bpe.op2,
        "op3_sharding": sharding.op3,
        "op4_token_counts": wordpiece.op4,
        "op5_quality": quality.op5,
        "op6_mixing": mixing.op6,
        "op7_toxicity": toxicity.op7,
        "op8_hnsw": hnsw.op8,
        "op9_line_dedup": lines.op9,
        "op10_simhash": simhash.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.OP6_SQL, "op9_line_dedup": lines.OP9_SQL}
