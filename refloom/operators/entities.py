"""Raw model hits to entities: merging fragments, grouping by field, choosing the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.entities import best_entities


def merge_fragments(hits: DataFrame, key: str = "citation_id") -> DataFrame:
    """Hits (key, label, word, start, end, score) with neighbours of a label merged: words joined without a space, the
    highest score kept. A hit joins the one before it if that has its label and ends where it starts, or one short."""
    order = Window.partitionBy(key).orderBy("start", "end")
    near = (F.lag("label").over(order) == F.col("label")) & (F.col("start") <= F.lag("end").over(order) + 1)
    islands = hits.withColumn("island", F.sum(F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "word")))
    merged = islands.groupBy(key, "island", "label").agg(parts.alias("parts"), F.max("score").alias("score"))
    return merged.select(key, "label", F.array_join(F.col("parts.word"), "").alias("word"), F.col("parts")[0]["start"].alias("start"), F.element_at("parts", -1)["end"].alias("end"), "score")


def group_entities(hits: DataFrame, key: str = "citation_id") -> DataFrame:
    """One row per key: entities, a map from each label to its words in order."""
    by_label = hits.groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word"))).alias("parts"))
    return by_label.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", F.col("parts.word")))).alias("entities"))


def clean_entities(df: DataFrame, entities: str = "entities") -> DataFrame:
    """Adds e: the best value of each field of a map of raw entities."""
    return df.withColumn("e", best_entities(F.col(entities)))
