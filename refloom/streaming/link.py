"""Citations as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refloom.functions.entities import best_entities
from refloom.plans.engine import Engine
from refloom.sources.storage import scratch


def parse_stream(citations: DataFrame, engine: Engine) -> DataFrame:
    """Adds parsed fields to a stream of (citation_id, citation); stateless, so it works in any output mode."""
    return engine.backend.ner(engine.backend.classify(citations, "citation"), "citation").withColumn("e", best_entities(F.col("entities")))


def unique_citations(citations: DataFrame, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Each text once within the watermark's delay."""
    return citations.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["citation"])


def link_stream(citations: DataFrame, engine: Engine, api: str, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Links each micro-batch and writes it below out, in a folder of the batch's own that a repeated batch overwrites. A batch's intermediate tables go with it."""

    def write(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            engine.link(batch, api).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return citations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
