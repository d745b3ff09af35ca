"""The stage near-duplicates finds nearly equal texts by SimHash, and tables of links go to few files."""

import random

from refloom.llm import components, shared
from refloom.llm.covering import near_links
from refloom.llm.similar import Similarity, similar_rows, sketch, shingle_set
from refloom.llm.text import WordHashes


def test_simhash_links_what_shares_no_table(spark):
    r = random.Random(7)
    how, texts = Similarity(tables=1, values=400), []
    for _ in range(8):
        words = [f"w{r.randrange(10**6)}" for _ in range(2000)]
        texts.append(" ".join(words))
        words[r.randrange(2000)] = "other"
        texts.append(" ".join(words))
    hashes = WordHashes()
    fps = [sketch(shingle_set(t, how.n, hashes)) for t in texts]
    near = [i for i in range(0, 16, 2) if ((fps[i] ^ fps[i + 1]) & (1 << 64) - 1).bit_count() <= how.radius]
    rows = similar_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) h", "text"), how).collect()
    of = {x.doc_id: x.component for x in rows}
    assert len(near) >= 4 and all(of[i] == of[i + 1] for i in near)
    assert len({of[i] for i in range(0, 16, 2)}) == 8


def test_equal_fingerprints_alone_join_nothing(spark):
    # one shingle each: a fingerprint of 64 bits says all of it; texts without words have 0
    rows = similar_rows(spark.createDataFrame([(1, "a b c"), (2, "A B C"), (3, "a b d"), (4, ""), (5, None)], "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) h", "text")).collect()
    of = {x.doc_id: x.component for x in rows}
    assert of[1] == of[2] != of[3] and of[4] == of[5] and len(set(of.values())) == 3


def test_rounds_of_few_links_write_few_files(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(df.rdd.getNumPartitions()) or shared.materialize(df, name))
    edges = spark.range(40).selectExpr("id a", "id + 1 b")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        found = {x.node: x.component for x in components.connected_components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == dict.fromkeys(range(41), 0) and set(written[1:]) == {1}


def test_links_of_the_search_stay_the_same(spark):
    table = spark.createDataFrame([(0,), (3,), (-1,)], "fp long")
    assert [tuple(x) for x in near_links(table, 2).collect()] == [(3, 0)]


def test_a_full_pool_keeps_what_it_met_again(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from refloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHED", 8)
    pool, learned = tokens._Pool(), []

    def learn(fresh):
        learned.extend(fresh.to_pylist())
        return np.array([ord(x[:1]) for x in fresh.to_pylist() for _ in range(2)], np.uint32), np.full(len(fresh), 2)

    for k in range(30):
        strings = [b"a", b"b", *(f"{chr(99 + k % 20)}{k}{i}".encode() for i in range(3))]
        rows = pool.rows(pa.array(strings, pa.large_binary()), learn)
        ids, ends = pool.of(rows)
        assert ids.tolist() == [x[0] for x in strings for _ in range(2)] and ends.tolist() == [2, 4, 6, 8, 10]
    assert learned.count(b"a") == learned.count(b"b") == 1 and len(pool.known) <= 13
