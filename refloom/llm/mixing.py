"""Mixing sources to target weights.

Sizes are summed per source, a rate of repetition follows per source, and each document is emitted floor(rate) times
plus once more if a hash of its id falls below the fraction. Everything is DataFrame operations: partial sums before
the only shuffle over documents, then work on one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.llm.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Number of WORD in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, size) to one row per source: source, source_size, target.

    Sources by code point, null last, weigh weights, repeating, and share `share` times all sizes. A target stops at
    cap times its source's size and the excess goes to the others by weight, again and again until none is above: that
    is the level L with sum(min(cap * size, L * weight)) = total. Sources whose ratio cap * size / weight is least stop
    first, so L follows from running sums in the order of that ratio. The two windows hold one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("position", F.row_number().over(order)).withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    ranked = Window.orderBy(F.col("most") / F.col("weight"), "position")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("below", F.col("level") <= F.col("most") / F.col("weight"))
    per = per.withColumn("level", F.min_by(F.when(F.col("below"), F.col("level")), F.when(F.col("below"), F.struct(F.col("most") / F.col("weight"), F.col("position")))).over(every))
    return per.select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most").alias("target"))


def hash_uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the id, or from the text where the id is null."""
    return F.shiftrightunsigned(F.when(doc_id.isNotNull(), F.xxhash64(F.lit(seed), doc_id)).otherwise(F.xxhash64(F.lit(seed), text)), 11) / F.lit(float(1 << 53))


def count_copies(docs: DataFrame, size: Column, keep: Sequence[Column], seed: int = 17, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """keep of every row of docs, with size, source_size, target and copies (how often the mix takes the row).

    Rows of one source that have the same id get the same number; a source of size 0 has target 0 and no copies; a
    null source is a source like any other; null texts have size 0 and as many copies as their source's rate gives;
    an empty table gives an empty one. Sums per source are formed before any shuffle. The table of sources is written
    first, so that Spark knows its size: it is broadcast below the usual threshold, else joined by shuffle, where AQE
    splits a hot source.
    """
    rows = docs.select(*keep, F.col("source").cast("string").alias("__source"), size.alias("size"), hash_uniform(F.col("doc_id"), F.col("text"), seed).alias("__u"))
    targets = materialize(source_targets(rows.select(F.col("__source").alias("source"), "size"), weights, share, cap), "mix-targets")
    joined = rows.join(targets, F.col("__source").eqNullSafe(F.col("source")), "left")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (F.col("__u") < rate - F.floor(rate)).cast("int")).cast("int")
    return joined.withColumn("copies", copies).drop("__u", "source", "__source")


def mix(docs: DataFrame, size: Column | None = None, **parameters) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    names = docs.columns
    plain = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.struct(*(F.col(n) for n in names)).alias("__row"))
    counted = count_copies(plain, count_words(F.col("text")) if size is None else size, [F.col("__row")], **parameters)
    many = counted.where("copies > 0").select("__row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return many.select(*(F.col("__row")[n].alias(n) for n in names))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_copies(docs, count_words(F.col("text")), [F.col("doc_id")])
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)
