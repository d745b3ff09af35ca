"""Fingerprints of 64 bits, and the covering locality-sensitive hashing by which near ones find each other.

The bit masks are structured so that any two fingerprints within the radius agree on all bits of some mask: every bit
position gets a nonzero vector of radius + 1 bits, and the mask of v keeps the positions whose vector has an odd inner
product with v. For r differing positions some v is orthogonal to all their vectors, so that mask ignores them all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.shared import materialize

BITS = 64


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """For each bit position, in how many of the 64-bit hashes it is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The SimHash, unsigned, of n hashes of which ones have each bit: a bit is 1 if it is set in over half of them."""
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 masks; the vectors of the bit positions go round through all nonzero ones."""
    many = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((i % many + 1) & v).count("1") % 2) for v in range(1, many + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _long(x: int) -> Column:
    return F.lit(_signed(x)).cast("long")


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fp to links (a, b) whose components are those of all pairs at radius or fewer differing bits.

    A fingerprint that meets another one in a table of the covering family is kept, with the bits that those tables
    ignore; only there can a near one differ. With radius 2, two such fingerprints are linked exactly if one of the two
    is, or both differ in one bit from, the same word: so each sends itself to that word for each of those bits, and to
    itself. All that meet at a word lie within 2 bits of each other, so one star there loses no link, and at most 65
    can meet. No pairs within a table's bucket are formed, however many copies fall into it.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2: the check by a shared centre covers no more")
    spark = fps.sparkSession
    masks = covering_masks(radius)
    every = (1 << BITS) - 1
    table = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_long(m)).alias("key"), _long(every ^ m).alias("free")) for t, m in enumerate(masks)))
    rows = fps.select("fp", F.explode(table).alias("x")).select("fp", "x.*")
    # most buckets hold one fingerprint: partial minima and maxima show which, and are all that is shuffled for them
    full = rows.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select(F.col("t").alias("t2"), F.col("key").alias("key2"))
    full = materialize(full, "simhash-buckets")
    met = rows.join(full, (F.col("t") == F.col("t2")) & (F.col("key") == F.col("key2")), "left_semi")
    free = met.groupBy("fp").agg(F.bit_or("free").alias("free"))
    single = [F.when(F.col("free").bitwiseAND(_long(1 << i)) != 0, F.col("fp").bitwiseXOR(_long(1 << i))) for i in range(BITS)] if radius == 2 else []
    if radius == 1:  # x and y differ in one bit: the word with that bit cleared is shared by these two only
        single = [F.when(F.col("free").bitwiseAND(_long(1 << i)) != 0, F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(_long(every ^ (1 << i))).alias("w"))) for i in range(BITS)]
        words = free.select("fp", F.explode(F.filter(F.array(*single), lambda x: x.isNotNull())).alias("w"))
    elif radius == 2:
        words = free.select("fp", F.explode(F.filter(F.array(F.col("fp"), *single), lambda x: x.isNotNull())).alias("w"))
    else:
        return spark.createDataFrame([], "a long, b long")
    stars = words.groupBy("w").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1).select(F.explode("all").alias("a"), F.array_min("all").alias("b"))
    return stars.where("a != b").distinct()
