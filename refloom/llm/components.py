"""Connected components of a graph that is held in tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.shared import materialize

#: Links in a file of a round's table, some 4 MB, so that small tables don't go to as many files as the session has partitions.
LINKS_A_FILE = 1 << 18


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links between integer nodes to (node, component), component being the least node reachable.

    Large-star and small-star steps in turn (Kiveris et al. 2014): edges are pointed at the least neighbour until each
    component is one star. The number of edges never grows and the rounds grow with the logarithm of a component's
    size. Minima are combined before each shuffle, and the joins are plain ones that AQE splits if a node is hot. Each
    round is written to the shared folder, in files by the number of links before; the driver sees two numbers a round. Nodes without a link don't appear;
    repeated links and loops do no harm; links with a null end are dropped.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "components")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        edges = materialize(small.coalesce(-(-before[0] // LINKS_A_FILE)), "components")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
