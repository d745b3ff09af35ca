"""A corpus, stage by stage: quality rules, near-duplicates, decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.llm.decontaminate import decontaminate_stage
from refloom.llm.mixing import mixing_stage
from refloom.llm.quality import quality_stage
from refloom.llm.shared import materialize
from refloom.llm.simhash import simhash_stage
from refloom.llm.tokens import tokens_stage

STAGES = [("quality", quality_stage), ("near-duplicates", simhash_stage), ("decontamination", decontaminate_stage), ("mixing", mixing_stage), ("tokens", tokens_stage)]

#: No SQL: near-duplicate components and token ids are beyond it; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
