"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gridloom.llm import jaccard, licenses, lm, media, mixing, oracles, pieces, quality, secrets, suffixes, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_mixing": mixing.op2_mixing,
        "op3_suffixes": suffixes.op3_suffixes,
        "op4_jaccard": jaccard.op4_jaccard,
        "op5_media": media.op5_media,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_lm": lm.op7_lm,
        "op8_secrets": secrets.op8_secrets,
        "op9_licenses": licenses.op9_licenses,
        "op10_pieces": pieces.op10_pieces,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
