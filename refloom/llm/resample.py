"""Quality by importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled as good) and one of raw text (all
documents), give each document a log ratio; adding Gumbel noise and taking the k largest keys draws k documents without
replacement in proportion to that ratio.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.mixing import hash_uniform
from refloom.llm.shared import materialize
from refloom.llm.text import WordHashes, rows_of, shingle_hashes

_TOKEN = re.compile(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+")
#: Keys are kept as multiples of 2 ** -20, so that sums of logarithms compare exactly.
SCALE = float(1 << 20)


@dataclass(frozen=True)
class Resampling:
    """buckets: of hashed n-grams; n_grams: up to so many tokens; fit_rows bounds the labelled documents of the target model (those with the least hash of the id); smoothing is added to each bucket."""

    buckets: int = 1 << 14
    n_grams: int = 2
    fit_rows: int = 20_000
    smoothing: float = 1.0
    seed: int = 29


def feature_buckets(text: str | None, how: Resampling, hashes: WordHashes) -> np.ndarray:
    """The bucket of every n-gram of a text, repeats included. Tokens are runs of word characters and runs of others."""
    words = hashes.of(_TOKEN.findall(text.encode("utf-8", "surrogatepass"))) if text else np.zeros(0, np.uint64)
    grams = [shingle_hashes(words, n) for n in range(1, how.n_grams + 1) if len(words) >= n]
    return (np.concatenate(grams) >> np.uint64(17)).astype(np.int64) % how.buckets if grams else np.zeros(0, np.int64)


def fit_models(docs: DataFrame, good: DataFrame, how: Resampling) -> tuple[np.ndarray, int]:
    """Log ratio of each bucket, target to raw, from all documents; good has the ids of target documents in doc_id.

    A task adds up its own documents; what is shuffled and what the driver gets are counts per bucket.
    """
    own = good.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(how.fit_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("__id"), "left").select("text", F.col("__id").isNotNull().alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros((2, how.buckets), np.int64)
        for batch in batches:
            for text, target in rows_of(batch, "text", "target"):
                found = np.bincount(feature_buckets(text, how, hashes), minlength=how.buckets)
                counts[0] += found
                if target:
                    counts[1] += found
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "raw", "target"])

    found = rows.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(how.buckets), np.zeros(how.buckets)
    at = found.column("bucket").to_numpy()
    raw[at], target[at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    if not target.sum():
        return np.zeros(how.buckets), 0
    p, q = target + how.smoothing, raw + how.smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum()), int(target.sum())


def score_documents(docs: DataFrame, ratios: np.ndarray, how: Resampling) -> DataFrame:
    """doc_id, n_features, log_ratio (null without features), key (log ratio and Gumbel noise, in 2 ** -20) of each row of docs."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), hash_uniform(F.col("doc_id"), F.col("text").cast("string"), how.seed).alias("u"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [feature_buckets(t, how, hashes) for (t,) in rows_of(batch, "text")]
            sums = [float(ratios[x].sum()) if len(x) else None for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(sums, pa.float64()), batch.column(2)], names=["doc_id", "n_features", "log_ratio", "u"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, n_features long, log_ratio double, u double")
    gumbel = -F.log(-F.log(F.col("u") + F.lit(2.0**-54)))
    return scored.select("doc_id", "n_features", "log_ratio", F.floor((F.col("log_ratio") + gumbel) * F.lit(SCALE)).cast("long").alias("key"))


def kth_largest(rows: DataFrame, k: int) -> int | None:
    """The k-th largest key (a long column, nulls left out) by counting: four rounds of at most 65536 counts; None if there are fewer, or k < 1."""
    rows = rows.where("key is not null").select(F.col("key").bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("x"))
    if k < 1:
        return None
    prefix = 0
    for shift in (48, 32, 16, 0):
        part = rows if shift == 48 else rows.where(F.shiftrightunsigned("x", shift + 16) == prefix)
        counts = part.groupBy(F.shiftrightunsigned("x", shift).bitwiseAND(F.lit(0xFFFF)).alias("d")).count().collect()
        for digit, n in sorted(((r["d"], r["count"]) for r in counts), reverse=True):
            if k <= n:
                prefix = prefix << 16 | digit
                break
            k -= n
        else:
            return None
    return prefix - (1 << 63)


def resample(docs: DataFrame, good: DataFrame, share: float, how: Resampling = Resampling()) -> DataFrame:
    """One row per row of docs: doc_id, n_features, log_ratio, key, kept.

    kept marks the round(share * rows) largest keys, and rows tied with the last of them (same id and text). Texts
    without tokens, null ones too, have no key and are not kept. Without target documents all log ratios are 0, so the
    draw is uniform. An empty table gives an empty one; repeated rows share one fate; other columns play no part.
    """
    ratios, _ = fit_models(docs, good, how)
    scored = materialize(score_documents(docs, ratios, how), "resample")
    total = scored.count()
    least = kth_largest(scored, min(round(share * total), scored.where("key is not null").count()))
    return scored.withColumn("kept", F.coalesce(F.col("key") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False))


def op3_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target text: documents labelled with quality 1; share: of these among all labelled rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null")
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    found = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1"), 1.0 if share is None else share)
    return found.select("doc_id", "n_features", "log_ratio", (F.col("key") / F.lit(SCALE)).alias("key"), "kept")
