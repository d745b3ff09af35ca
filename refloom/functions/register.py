"""The string similarities as functions of a session's SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from refloom.functions.journal import score_names
from refloom.functions.similarity import _ratio


def register(spark: SparkSession) -> None:
    """string_ratio(a, b) and journal_name_score(a, b), both of normalized strings; Arrow batches, null for null in the ratio."""
    spark.udf.register("string_ratio", _ratio)
    spark.udf.register("journal_name_score", score_names)
