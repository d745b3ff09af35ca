"""SimHash near-duplicates; fingerprints find each other by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.components import connected_components
from refloom.llm.covering import BITS, bits_set, covering_masks, majority, near_links
from refloom.llm.shared import materialize
from refloom.llm.similar import Similarity, similar_rows
from refloom.llm.text import lean, rows_of

__all__ = ["BITS", "covering_masks", "drop_near_duplicates", "drop_similar", "fingerprint", "fingerprints", "near_duplicates", "near_links", "op2_simhash", "simhash_stage"]


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """The SimHash of a text, unsigned; 0 for a null text or one without words.

    A-Z are lower-cased, words stand between ASCII white space, n-word shingles are joined by one space and count as
    often as they occur; fewer than n words are one shingle. A bit is 1 if it is set in over half the XXH64 values.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    k = max(len(words) - n + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: k - 1].tolist()]
    stops = (ends[min(n, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, k, 1 << 16):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], np.uint64)
        ones += bits_set(hashes)
    return majority(ones, k)


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", n: int = 3, seed: int = 42) -> DataFrame:
    """keep of every row of docs, and fp: the fingerprint of its whole text as a (signed) long."""
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, n, seed) for (t,) in rows_of(batch, "__text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found)], names=[*keep, "fp"])

    return rows.mapInArrow(lean(run), schema)


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """fp2, component and component_id of each distinct fp of rows (doc_id, fp), written to the shared folder."""
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = connected_components(near_links(groups.select("fp"), radius))
    classes = groups.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    leaders = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    return materialize(classes.join(leaders, "component").select(F.col("fp").alias("fp2"), "component", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, radius: int = 2, n: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id (the least doc_id reachable over links).

    Texts without words have fingerprint 0 and are linked like any other. Repeated rows give repeated results; a null
    doc_id counts in no minimum, so a component of such rows only has a null component_id; an empty table gives an
    empty one; other columns of docs play no part.
    """
    rows = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", n, seed), "simhash")
    return rows.join(_classes(rows, radius), F.col("fp") == F.col("fp2")).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 2, n: int = 3, seed: int = 42) -> DataFrame:
    """One row of docs for each group of near-duplicates, with the columns of docs: the one with the least doc_id (a null
    one if the group has no other), of several such the one with the least text hash, of equal ones any.

    The choice is made on a table of ids and hashes; texts are shuffled once, to be joined with what is kept. That grows
    with the documents, so it is never broadcast: one plan at every size.
    """
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = materialize(fingerprints(hashed, ["doc_id", "h"], "text", n, seed), "simhash")
    return _keep_one(docs, rows.join(_classes(rows, radius), F.col("fp") == F.col("fp2")))


def _keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of docs for each component of found (doc_id, h, component), as drop_near_duplicates says."""
    names = docs.columns
    equal = found.groupBy("component", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    best = equal.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h", "n")).alias("b"))
    keep = materialize(best.select(F.col("b.doc_id").alias("__id"), F.col("b.h").alias("__h"), F.col("b.n").alias("__n")), "simhash-keep")
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    joined = own.join(keep.hint("merge"), doc_id.eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__h")))
    kept = joined.where("__n = 1").unionByName(joined.where("__n > 1").dropDuplicates(["__id", "__h"]))
    return kept.select(*(F.col(f"c{i}").alias(x) for i, x in enumerate(names)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_similar(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """As drop_near_duplicates, but the groups are those of texts whose shingles have a Jaccard similarity of how.least or more.

    They meet by SimHash of these shingles and the covering search first; similar_rows says how those further apart do.
    """
    return _keep_one(docs, similar_rows(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), how))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)
