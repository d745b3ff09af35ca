"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles (powers of two). An item's sketch is its bottom-k MinHash:
the k least of its hashed shingles, with k set by its partition's upper size u to floor((1 - t) * u) + 1 for
containment t. A document with at least t of an item's shingles lacks at most (1 - t) * u of them, so it has one of the
k at least: the search misses no item, however long the document is. Sketch hits are candidates; exact containment in
the set of the whole document's shingles decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from refloom.llm.text import WordHashes, lean, plain_words, rows_of, shingle_hashes

#: Bytes of item texts that go to executors at once; a larger benchmark is searched for in several blocks, each against all documents.
BLOCK_BYTES = 8 << 20
#: Documents are hashed in stretches of so many words, so a very long one needs little memory at a time.
STRETCH = 1 << 18


def item_shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashed shingles of an item, sorted; an item of fewer than n words is one shingle of its own length."""
    return np.unique(shingle_hashes(hashes.of(plain_words(text)), n))


def partition_of(size: int) -> int:
    """Upper size of the partition (1, 2, 4, 8, ...) of an item with that many shingles."""
    return 1 << max(size - 1, 0).bit_length()


def sketch(shingles: np.ndarray, containment: float) -> np.ndarray:
    """The item's bottom-k MinHash, as the module's text says; shingles are sorted hashes."""
    return shingles[: int((1 - containment) * partition_of(len(shingles)) + 1e-9) + 1]


@dataclass(frozen=True)
class ItemIndex:
    """What executors need of a block of items. A short item, under n words, is held against windows of its own length."""

    n: int
    containment: float
    item_ids: list
    shingles: list[np.ndarray]
    words: list[int]

    @classmethod
    def of(cls, items: list[tuple], n: int, containment: float) -> ItemIndex:
        hashes = WordHashes()
        rows = [(i, item_shingles(t, n, hashes), min(len(plain_words(t)), n)) for i, t in items]
        rows = [r for r in rows if len(r[1])]
        return cls(n, containment, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])

    def tables(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By window length: a bit table that few other hashes pass, the sorted sketch hashes, and the item of each."""
        found = {}
        for length in sorted(set(self.words)):
            own = [k for k, w in enumerate(self.words) if w == length]
            keys = [sketch(self.shingles[k], self.containment) for k in own]
            hashes, items = np.concatenate(keys), np.repeat(own, [len(x) for x in keys])
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << max(16, (64 * len(hashes)).bit_length()), bool)
            bits[hashes & np.uint64(len(bits) - 1)] = True
            found[length] = (bits, hashes[order], items[order])
        return found


class Searcher:
    """Finds the items of an index in texts; made once per task."""

    def __init__(self, index: ItemIndex):
        self.index, self.tables, self.hashes = index, index.tables(), WordHashes()

    def find(self, text: str | None) -> list[tuple]:
        """(item_id, containment, shingles found) of each item contained in the whole text, in the items' order."""
        words = plain_words(text)
        of_words = np.concatenate([self.hashes.of(words[a : a + STRETCH]) for a in range(0, len(words), STRETCH)]) if words else np.zeros(0, np.uint64)
        found = []
        for length, (bits, keys, items) in self.tables.items():
            if len(of_words) < length:
                continue
            shingles = shingle_hashes(of_words, length)
            hit = np.unique(shingles[bits[shingles & np.uint64(len(bits) - 1)]])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
            candidates = sorted({int(items[j]) for a, b in zip(lo, hi) for j in range(a, b)})
            if not candidates:
                continue
            whole = np.unique(shingles)
            for k in candidates:
                own = self.index.shingles[k]
                at = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
                shared = int((whole[at] == own).sum())
                if shared >= self.index.containment * len(own) - 1e-9:
                    found.append((k, shared / len(own), shared))
        return [(self.index.item_ids[k], c, s) for k, c, s in sorted(found)]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of block_bytes of text on average, as many as the benchmark's size asks for."""
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = total // block_bytes + 1
    for k in range(many):
        own = rows if many == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        found = own.distinct().toArrow()
        if found.num_rows:
            yield sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True), key=str)


def find_items(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", n: int = 5, containment: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs and item that it contains: keep of docs, item_id, containment, shared.

    Words are lower-cased and taken without ASCII punctuation; shingles have n words and count once. Null texts hold no
    item and null or wordless items are in no document; an item that is there twice is found twice if its ids differ;
    empty tables give an empty result; other columns play no part; columns to keep can't have names of the result.
    """
    keep = ["doc_id"] if keep is None else list(keep)
    if clash := set(keep) & {"item_id", "containment", "shared"}:
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"item_id {kind}, containment double, shared long"])
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = None
    for items in _blocks(benchmark, block_bytes):
        index = ItemIndex.of(items, n, containment)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            search = Searcher(index)
            for batch in batches:
                hits = [(at, *x) for at, (t,) in enumerate(rows_of(batch, "__text")) for x in search.find(t)]
                if hits:
                    at, ids, share, shared = (list(c) for c in zip(*hits))
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in range(len(keep))), pa.array(ids, item_type), pa.array(share, pa.float64()), pa.array(shared, pa.int64())], names=[*keep, "item_id", "containment", "shared"])

        part = rows.mapInArrow(lean(run), schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, containment: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that contain no item, with the columns of docs; block after block of items, nothing is shuffled."""
    for items in _blocks(benchmark, block_bytes):
        index = ItemIndex.of(items, n, containment)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], index=index, at=at) -> Iterator[pa.RecordBatch]:
            search = Searcher(index)
            for batch in batches:
                yield batch.filter(pa.array([not search.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
