"""The corpus pipeline: operators in a row, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from echofold.llm import common, linededup, mixing, packing, simhash, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", linededup.stage),
    ("SimHash near-dedup", simhash.stage),
    ("mixing sources to target weights", mixing.stage),
    ("best-fit packing", packing.stage),
]

#: Stages are models, searches and packings that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
