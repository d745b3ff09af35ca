"""Near-duplicates by exact Jaccard similarity of word shingles, met by SimHash and, further apart, through MinHash tables.

Texts with equal sets of shingles are one node. Nodes whose SimHash fingerprints differ in few bits meet by the covering
search, which misses none of them. Such a radius holds nearly equal texts only (at a similarity of 0.8 some 10 of 64
bits differ, and no covering search is selective there), so nodes meet in tables too, whose key is a few MinHash values; within a key
they are sorted by further values, so that those most alike are neighbours. First each is compared with the first of
its key, then with its nearest neighbours that are not yet in its component. That joins nearly all that belongs
together, without pairs of a whole group. Where nodes of one key are then still in several components, those of
different components are compared by all their MinHash values, block by block, and what may be similar by these is
compared by its shingles there and then: a block gives a forest of links, at most one a node, and no pairs that are not
linked. What meets is linked only if the exact similarity of the whole texts is high enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.components import connected_components
from refloom.llm.covering import BITS, bits_set, majority, near_links
from refloom.llm.shared import materialize
from refloom.llm.text import WordHashes, lean, rows_of, shingle_hashes

#: Shingles that are hashed at once, which bounds the memory that a long text takes.
STRETCH = 4096


@dataclass(frozen=True)
class Similarity:
    """A pair of similarity s meets in a table with probability s ** values: at 0.8, 99.997 % meet in one of 20 tables of 4."""

    least: float = 0.8
    n: int = 5
    tables: int = 20
    values: int = 4
    #: differing bits of two fingerprints up to which texts are compared
    radius: int = 2
    #: neighbours within a key that each is compared with first
    neighbours: int = 8
    #: share of equal MinHash values from which two texts are compared: 4.5 standard errors below 0.8 for 80 values
    may: float = 0.6
    #: nodes of a key that are compared with each other, or with as many others, at a time
    block: int = 1024
    #: shingles that these have together, at about
    block_shingles: int = 1 << 19


def shingle_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; words and shingles are those of simhash.fingerprint."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.unique(shingle_hashes(hashes.of(words), n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def sketch(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingles, signed; 0 for an empty one. Equal sets have equal ones."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(shingles), STRETCH):
        ones += bits_set(shingles[a : a + STRETCH])
    found = majority(ones, len(shingles))
    return found - (1 << 64) if found >> 63 else found


class MinHashes:
    """MinHash values of a set; equal sets have equal ones."""

    def __init__(self, how: Similarity):
        r = np.random.Generator(np.random.PCG64(42))
        many = how.tables * how.values
        self.how = how
        self.xor, self.times = (r.integers(0, 1 << 64, (many, 1), np.uint64) for _ in range(2))
        self.times |= np.uint64(1)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.xor), np.iinfo(np.uint64).max)
        for a in range(0, len(shingles), STRETCH):
            x = (shingles[a : a + STRETCH] ^ self.xor) * self.times
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            np.minimum(least, x.min(axis=1), out=least)
        return least

    def keys(self, shingles: np.ndarray) -> tuple[list[int], list[int]]:
        """For each table its key, and where a set stands within the key (by two values of the next table), as signed longs."""
        rows = self.of(shingles).reshape(self.how.tables, self.how.values)
        keys = [xxhash.xxh64_intdigest(x.tobytes(), t) for t, x in enumerate(rows)]
        after = np.roll(rows, -1, axis=0)
        places = (after[:, 0] & np.uint64(0xFFFFFFFF00000000)) | (after[:, -1] >> np.uint64(32))
        return np.array(keys, np.uint64).view(np.int64).tolist(), places.view(np.int64).tolist()


def _meetings(tables: DataFrame) -> DataFrame:
    """(a, b) of nodes that are to be compared, each with the first of its key, and (t, key, n) of keys and how many nodes a partition has of them, from rows (t, key, place, node) sorted within their partitions.

    A key that is alone in a partition with one node is left out unless it may go on in another partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, n, before = None, 0, 0, False
        for batch in batches:
            pairs, keys = [], []
            for t, key, node in rows_of(batch, "t", "key", "node"):
                if own != (t, key):
                    if own and (n > 1 or not before):
                        keys.append((*own, n))
                    own, first, n, before = (t, key), node, 0, own is not None
                else:
                    pairs.append((max(node, first), min(node, first)))
                n += 1
            if pairs or keys:
                yield _meeting_batch(pairs, keys)
        if own:
            yield _meeting_batch([], [(*own, n)])

    return tables.mapInArrow(lean(run), "a long, b long, t int, key long, n long")


def _neighbours(tables: DataFrame, of: DataFrame, how: Similarity) -> DataFrame:
    """(a, b): of keys whose nodes are in several components, each node and those of its how.neighbours predecessors by place that are in another one.

    Keys of few nodes are dealt out whole, so all their pairs are met; those of many in ranges, as they may be of any
    size (what ranges part is left to _across).
    """
    own = tables.join(of.select(F.col("node").alias("__node"), "component"), F.col("node") == F.col("__node"), "left").select("t", "key", "place", "node", F.coalesce("component", "node").alias("component"))
    own = materialize(own, "similar-placed")
    open_keys = own.groupBy(F.col("t").alias("__t"), F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("__t", "__key", "n")
    some = own.join(open_keys, (F.col("t") == F.col("__t")) & (F.col("key") == F.col("__key"))).select(*own.columns, "n")
    some = materialize(some, "similar-open-keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, last = None, []
        for batch in batches:
            pairs = []
            for t, key, node, component in rows_of(batch, "t", "key", "node", "component"):
                if key_now != (t, key):
                    key_now, last = (t, key), []
                pairs += [(max(node, x), min(node, x)) for x, c in last if c != component and x != node]
                last = [*last[1 - how.neighbours :], (node, component)] if how.neighbours > 1 else [(node, component)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])

    order, few = ["t", "key", "place", "node"], F.col("n") <= how.neighbours + 1
    met = some.where(few).repartition("t", "key").sortWithinPartitions(*order).mapInArrow(lean(run), "a long, b long")
    return met.unionByName(some.where(~few).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(run), "a long, b long")).distinct()


def _meeting_batch(pairs: list[tuple], keys: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    rows = [(*p, None, None, None) for p in pairs] + [(None, None, *k) for k in keys]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["a", "b", "t", "key", "n"])


def _forest(node: np.ndarray, component: np.ndarray, apart: np.ndarray | None, minima: np.ndarray, shingles: list[np.ndarray], how: Similarity) -> list[tuple[int, int]]:
    """Links (a, b) between similar nodes of a block, or of two (apart says which one has a node): enough to join all components that such links join, and none within one.

    The sets are compared where least of the minima say that they may be similar.
    """
    size = np.fromiter(map(len, shingles), np.int64, len(shingles))
    ends = np.cumsum(size)
    starts = ends - size
    words, ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles]), return_inverse=True)
    component, own, found = component.copy(), np.zeros(len(words), bool), []
    least = int(how.may * how.tables * how.values)
    for k in range(len(node)):
        other = component != component[k]
        other[: k + 1] = False
        if apart is not None:
            other &= apart != apart[k]
        other &= np.minimum(size, size[k]) >= (how.least - 1e-9) * np.maximum(size, size[k])
        other = np.flatnonzero(other)
        near = other[(minima[other] == minima[k]).sum(axis=1) >= least].tolist()
        if not near:
            continue
        mine = ids[starts[k] : ends[k]]
        own[mine] = True
        for x in near:
            if component[x] != component[k]:
                both = np.count_nonzero(own[ids[starts[x] : ends[x]]])
                if both >= (how.least - 1e-12) * (size[x] + size[k] - both):
                    found.append((max(int(node[x]), int(node[k])), min(int(node[x]), int(node[k]))))
                    component[component == component[x]] = component[k]
        own[mine] = False
    return found


def _across(tables: DataFrame, full: DataFrame, of: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame | None:
    """Links (a, b) between similar nodes of one key (of those in full) and different components, enough to join these; null if all keys' nodes are joined.

    Pairs of blocks of a key's nodes are groups, so a group has 2 * how.block nodes and 2 * how.block_shingles shingles
    at about, however many a key has.
    """
    own = tables.select("t", "key", "node").join(full, ["t", "key"], "left_semi").join(of.select(F.col("node").alias("__node"), "component"), F.col("node") == F.col("__node"), "left").select("t", "key", "node", F.coalesce("component", "node").alias("component"))
    own = materialize(own, "similar-keys")
    many = materialize(own.groupBy("t", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("t", "key"), "similar-open")
    if many.isEmpty():
        return None

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minima = WordHashes(), MinHashes(how)
        for batch in batches:
            sets = [shingle_set(text, how.n, hashes) for (text,) in rows_of(batch, "text")]
            found = [(minima.of(x) >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "minima", "shingles"])

    members = own.join(many, ["t", "key"], "left_semi")
    needed = members.select(F.col("node").alias("__node")).distinct()
    values = materialize(texts.select("node", "text").join(needed, F.col("node") == F.col("__node"), "left_semi").mapInArrow(lean(sign), "node long, minima binary, shingles binary"), "similar-values").withColumnRenamed("node", "__node")
    sized = materialize(members.join(values.select("__node", (F.length("shingles") / 8).alias("size")), F.col("node") == F.col("__node")).drop("__node"), "similar-members")
    blocks = sized.groupBy("t", "key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / how.block), F.ceil(F.sum("size") / how.block_shingles)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = sized.join(blocks, ["t", "key"]).withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("t", "key", "node", "component", "i", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).join(values, F.col("node") == F.col("__node")).drop("__node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        minima, i = np.frombuffer(b"".join(group["minima"]), np.uint32).reshape(len(group), -1), group["i"].to_numpy()
        apart = i if group["lo"].iloc[0] != group["hi"].iloc[0] else None
        found = _forest(group["node"].to_numpy(), group["component"].to_numpy(), apart, minima, [np.frombuffer(x, np.uint64) for x in group["shingles"]], how)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return pairs.groupBy("t", "key", "lo", "hi").applyInPandas(compare, "a long, b long").distinct()


def _links(pairs: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """Those of the pairs (a, b) whose texts (node, text) are similar."""
    left, right = (texts.select(F.col("node").alias(f"n{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    joined = pairs.select("a", "b").join(left.hint("merge"), F.col("a") == F.col("na")).join(right.hint("merge"), F.col("b") == F.col("nb")).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, before = WordHashes(), (None, None)
        for batch in batches:
            found = []
            for a, b, x, y in rows_of(batch, "a", "b", "ta", "tb"):
                if before[0] != b:  # rows come sorted by b
                    before = (b, shingle_set(y, how.n, hashes))
                if jaccard(shingle_set(x, how.n, hashes), before[1]) >= how.least - 1e-12:
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return materialize(joined.mapInArrow(lean(run), "a long, b long"), "similar-links")


def _near(nodes: DataFrame, how: Similarity) -> DataFrame:
    """(a, b) of nodes (node, fp) that are to be compared: those of equal fingerprints with the least of them, and the least ones of fingerprints that near_links links."""
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "similar-fingerprints")
    left, right = (heads.select(F.col("fp").alias(f"f{x}"), F.col("head").alias(f"h{x}")) for x in "ab")
    apart = near_links(heads.select("fp"), how.radius).join(left, F.col("a") == F.col("fa")).join(right, F.col("b") == F.col("fb")).select(F.greatest("ha", "hb").alias("a"), F.least("ha", "hb").alias("b"))
    equal = nodes.select("node", "fp").join(left, F.col("fp") == F.col("fa")).where("node != ha").select(F.col("node").alias("a"), F.col("ha").alias("b"))
    return apart.unionByName(equal)


def similar_rows(hashed: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """doc_id, h and component of every row of hashed (doc_id, h, text), h being a hash of the text.

    Components are those of the links between texts whose similarity is how.least or more. Texts without words are
    alike; null texts are such texts.
    """
    kind = hashed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minima = WordHashes(), MinHashes(how)
        for batch in batches:
            nodes, fps, keys, places = [], [], [], []
            for (text,) in rows_of(batch, "text"):
                own = shingle_set(text, how.n, hashes)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
                fps.append(sketch(own))
                k, p = minima.keys(own) if len(own) else ([], [])
                keys.append(k)
                places.append(p)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, longs), pa.array(places, longs)], names=["doc_id", "h", "node", "fp", "keys", "places"])

    rows = materialize(hashed.select("doc_id", "h", "text").mapInArrow(lean(run), f"doc_id {kind}, h long, node long, fp long, keys array<long>, places array<long>"), "similar")
    # equal nodes have equal keys; h of one of its texts stands for a node
    nodes = materialize(rows.groupBy("node").agg(F.min("h").alias("h"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min("places").alias("places")), "similar-nodes")
    tables = nodes.select("node", F.posexplode(F.arrays_zip("keys", "places")).alias("t", "x")).select("t", F.col("x.keys").alias("key"), F.col("x.places").alias("place"), "node")
    order = ["t", "key", "place", "node"]
    met = materialize(_meetings(tables.repartitionByRange(*order).sortWithinPartitions(*order)), "similar-meetings")
    pairs = materialize(met.where("a != b").select("a", "b").unionByName(_near(nodes, how)).distinct(), "similar-pairs")
    full = materialize(met.where("t is not null").groupBy("t", "key").agg(F.sum("n").alias("n")).where(F.col("n") > how.neighbours + 1).select("t", "key"), "similar-full")
    # every node that met another met the first of its key, or is that first; a key that ranges part has a first in each
    both = pairs.select(F.explode(F.array("a", "b")).alias("met")).unionByName(tables.join(met.where("t is not null and n = 1").select(F.col("t").alias("__t"), F.col("key").alias("__key")), (F.col("t") == F.col("__t")) & (F.col("key") == F.col("__key"))).select(F.col("node").alias("met"))).distinct()
    heads = nodes.join(both, F.col("node") == F.col("met"), "left_semi").select("node", F.col("h").alias("__h"))
    # texts are shuffled once, to be joined with the nodes that met others; that grows with the documents, so it is never broadcast
    texts = materialize(hashed.select("h", "text").join(heads.hint("merge"), F.col("h") == F.col("__h")).groupBy("node").agg(F.first("text").alias("text")), "similar-texts")
    links = _links(pairs, texts, how)
    of = materialize(connected_components(links), "similar-components")
    links = links.unionByName(_links(materialize(_neighbours(tables, of, how), "similar-neighbours"), texts, how))
    of = materialize(connected_components(links), "similar-components")
    if not full.isEmpty():
        more = _across(tables.select(F.col("t").cast("int").alias("t"), "key", "node"), full, of, texts, how)
        if more is not None:
            links = links.unionByName(materialize(more, "similar-across"))
            of = materialize(connected_components(links), "similar-components")
    of = of.withColumnRenamed("node", "__node")
    return rows.select("doc_id", "h", "node").join(of, F.col("node") == F.col("__node"), "left").select("doc_id", "h", F.coalesce("component", "node").alias("component"))
