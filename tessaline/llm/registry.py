"""The queries of this package and, where SQL can express them, the SQL for their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessaline.llm import ann, bpe, chat, licenses, mixing, neardup, substrings, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_mixing": mixing.op2_mixing,
        "op3_warc": warc.op3_warc,
        "op4_licenses": licenses.op4_licenses,
        "op5_substrings": substrings.op5_substrings,
        "op6_neardup": neardup.op6_neardup,
        "op7_bpe": bpe.op7_bpe,
        "op8_chat": chat.op8_chat,
        "op9_topk": topk.op9_topk,
        "op10_ann": ann.op10_ann,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """No SQL for a learned lexicon (op1), draws from hashes (op2, pipeline), BPE merges (op7) and graph search (op10)."""
    return {
        "op3_warc": warc.OP3_SQL,
        "op4_licenses": licenses.OP4_SQL,
        "op5_substrings": substrings.OP5_SQL,
        "op6_neardup": neardup.OP6_SQL,
        "op8_chat": chat.OP8_SQL,
        "op9_topk": topk.OP9_SQL,
    }
