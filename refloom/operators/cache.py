"""Work done once per distinct input, and results kept between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cache_key(citation: Column, api: Column, output: Column) -> Column:
    return F.md5(F.concat_ws("|", citation, api, output).cast("binary"))


def once_per_key(df: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work on the distinct keys of df only, joined back on them; null keys are equal to each other."""
    done = work(df.select(*keys).distinct())
    left, right = df.alias("l"), done.alias("r")
    on = None
    for k in keys:
        same = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        on = same if on is None else on & same
    return left.join(right, on, "left").select("l.*", *(f"r.{c}" for c in done.columns if c not in keys))


def not_yet_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys have no result yet."""
    return df.join(done.select(*keys), keys, "left_anti")


def _upto(counts: dict[int, int], keep: int, last: int) -> tuple[int, int]:
    """The first of the classes 0 to last with which there are keep rows, and how many of its rows are needed."""
    cut = 0
    while cut < last and counts.get(cut, 0) < keep:
        keep -= counts.get(cut, 0)
        cut += 1
    return cut, keep


def evict(store: DataFrame, limit: int, share: float = 0.8, inserted: str = "inserted_at", ranges: int = 200) -> DataFrame:
    """A store of more than limit rows, cut to its newest share * limit; a smaller one as it is.

    Rows of equal time are in the order of a hash of the row, so the cut is repeatable. Rows are counted by range of
    their time, where each edge between ranges, and so any time that many rows share, is a range of its own; only the
    range with the cut, one of `ranges`, is put in order, or, where its rows share one time, one of 65,536 of its hashes.
    """
    n = store.count()
    if n <= limit:
        return store
    keep, own = int(share * limit), F.xxhash64(*store.columns)
    edges = sorted(set(store.agg(F.percentile_approx(inserted, [i / ranges for i in range(1, ranges)], 10_000)).first()[0]), reverse=True)
    all_edges = F.array(*map(F.lit, edges))
    # newest first: above the first edge, at it, between it and the second...
    place = 2 * F.size(F.filter(all_edges, lambda e: e > F.col(inserted))) + F.array_contains(all_edges, F.col(inserted)).cast("int")
    rows = store.select(*store.columns, place.alias("__place"), own.alias("__hash"))
    cut, keep = _upto(dict(rows.groupBy("__place").count().collect()), keep, 2 * len(edges))
    whole, last = rows.where(F.col("__place") < cut), rows.where(F.col("__place") == cut)
    if cut % 2:
        last = last.withColumn("__place", F.shiftrightunsigned("__hash", 48).cast("int"))
        cut, keep = _upto(dict(last.groupBy("__place").count().collect()), keep, 65_535)
        whole, last = whole.unionByName(last.where(F.col("__place") < cut)), last.where(F.col("__place") == cut)
    some = last.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(inserted), "__hash"))).where(F.col("__r") <= keep)
    return whole.select(*store.columns).unionByName(some.select(*store.columns))


def hit_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: total, hits (rows beyond the first of their keys), rate as text with one decimal."""
    n = df.groupBy(*keys).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct_keys"))
    return n.select("total", (F.col("total") - F.col("distinct_keys")).alias("hits"), F.concat(F.format_number(F.coalesce(100 * F.try_divide(F.col("total") - F.col("distinct_keys"), F.col("total")), F.lit(0.0)), 1), F.lit("%")).alias("rate"))
