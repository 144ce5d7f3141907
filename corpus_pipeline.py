"""The corpus pipeline: toxicity, near duplicates, secrets, mixing and encoding, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import jaccard, mixing, pieces, secrets, toxicity
from gridloom.llm.common import materialize, table

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("secret_scans", secrets.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]

#: Learned scores, similarity clusters and encodings have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
