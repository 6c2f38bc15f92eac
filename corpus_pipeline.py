"""The corpus pipeline: quality rules, language ID, near-dedup by SimHash and Jaccard similarity, PII, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Null texts and ids, repeated rows, empty tables and extra
columns are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelagia.llm import language_id, packing, pii, quality_rules, simhash
from pelagia.llm.shared import materialise

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("language_id", language_id.stage),
    ("simhash_dedup", simhash.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: Expectation-maximisation, k-means and tokenising are beyond SQL; tests hold the stages against brute force or held-out
#: accuracy, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
