"""The store of results: versions, writers at the same time, counts, clearing and eviction."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from refloom.operators import cache
from refloom.operators.store import ResultStore


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, str(tmp_path / "store"), ["key"], "key string, n int", limit=100)


def results(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, n int")


def contents(frame):
    return {r.key: r.n for r in frame.collect()}


def test_two_writers_and_a_reader(spark, store):
    failed = []

    def write(name):
        try:
            for k in range(4):
                store.put(results(spark, (f"{name}{k}", k)))
        except Exception as e:
            failed.append(e)

    store.put(results(spark, ("first", 0)))
    before = store.rows()
    writers = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    [w.start() for w in writers]
    seen = []
    while any(w.is_alive() for w in writers):
        seen.append(set(contents(store.rows())))
    [w.join() for w in writers]
    assert not failed and contents(before) == {"first": 0}
    assert all(x <= y for x, y in zip(seen, seen[1:], strict=False))
    assert contents(store.rows()) == {"first": 0} | {f"{n}{k}": k for n in "ab" for k in range(4)} and store.version()["version"] == 9


def test_only_one_writer_takes_a_version(store):
    taken = []

    def change(v):
        return v | {"asked": v["asked"] + 1}

    threads = [threading.Thread(target=lambda: taken.append(store._publish(change)["version"])) for _ in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(taken) == list(range(1, 13)) and store.version()["asked"] == 12


def test_counts_clear_and_vacuum(spark, store):
    assert store.stats().first().asDict() == {"version": 0, "entries": 0, "entry_limit": 100, "asked": 0, "hits": 0, "misses": 0, "rate": "0.0%"}
    store.put(results(spark, ("a", 1), ("b", 2)))
    store.put(results(spark, ("b", 3)))
    known, new = store.look_up(spark.createDataFrame([("a", 7), ("b", 8), ("c", 9), (None, 10)], "key string, n2 int"))
    assert {(r.key, r.n2, r.n) for r in known.collect()} == {("a", 7, 1), ("b", 8, 3)} and {(r.key, r.n2) for r in new.collect()} == {("c", 9), (None, 10)}
    assert store.stats().first().asDict() == {"version": 3, "entries": 2, "entry_limit": 100, "asked": 4, "hits": 2, "misses": 2, "rate": "50.0%"}
    earlier = store.rows()
    store.clear()
    assert contents(store.rows()) == {} and store.stats().first().hits == 0 and contents(earlier) == {"a": 1, "b": 3}
    store.put(results(spark, ("d", 4)))
    assert store.vacuum() == 2 and contents(store.rows()) == {"d": 4} and store.version()["version"] == 5
    assert store.put(results(spark, ("e", 5))) == 6 and contents(store.rows()) == {"d": 4, "e": 5}


def test_compacting_keeps_the_newest_and_what_others_put(spark, store):
    times = spark.range(150).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").cast("int").alias("n"), F.timestamp_seconds(F.col("id")).alias("inserted_at"))
    store.put(times)
    write, evicted = store._publish, []

    def late(change):  # another writer publishes first
        if not evicted:
            evicted.append(1)
            store.put(results(spark, ("late", 0)))
        return write(change)

    store._publish = late
    store.compact()
    assert set(contents(store.rows())) == {f"k{i}" for i in range(70, 150)} | {"late"} and len(store.version()["parts"]) == 2


@pytest.mark.parametrize("shared", [0, 900, 1000])
def test_eviction_with_one_time_for_many(spark, shared):
    """As after a bulk load: rows that share a time are cut by a hash, the same ones each time."""
    rows = [(i, 500 if i < shared else i) for i in range(1000)]
    store = spark.createDataFrame(rows, "k int, inserted_at int").repartition(5)
    kept = [r.k for r in cache.evict(store, 999, 0.6).collect()]
    assert sorted(kept) == sorted(r.k for r in cache.evict(store.repartition(3), 999, 0.6).collect()) and len(set(kept)) == 599
    assert Counter(dict(rows)[k] for k in kept) == Counter(sorted((t for _, t in rows), reverse=True)[:599])
