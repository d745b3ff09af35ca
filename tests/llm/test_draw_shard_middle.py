"""Resampling towards a target, sharding and fill-in-middle, against brute-force versions and their laws."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from refloom.llm import middle, queries, sharding, targets
from refloom.llm.shared import free_names

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (4, "one two"), (None, "no id, but <P> a marker"), (None, None), (5, "Ünï cödé 😀😀x9y\r\nand LINES\n\n"), (6, "word " * 30_000), (7, "a<S"), (8, "<"), (9, "x" * 5_000), (10, "ends with a letter"), (11, "퟿\U0010ffff 1 2 3")]


def table(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs.withColumns({c: F.lit(c) for c in ("number", "n", "form", "output", "shard", "slot", "at", "weight", "rank", "s", "t", "__text")}) if extra else docs


def some_rows(n, seed):
    r = random.Random(seed)
    words = ["the", "of", "Data", "über", "x1", "spark", "10", "zzz", *("".join(r.choice("abcdeé") for _ in range(3)) for _ in range(60))]
    return [(i, r.choice([" ", "-", "\n"]).join(r.choice(words) for _ in range(r.randint(0, 70)))) for i in range(n)]


def brute_draw(rows, items, how):
    def feats(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % how.buckets for n in range(1, how.n_grams + 1) for i in range(len(words) - n + 1)]

    found = [feats(t) for _, t in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in items for b in feats(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + how.buckets) / ((s[b] + 1) * (t.total() + how.buckets))))
    out = []
    for (i, _), (n_words, f) in zip(rows, found, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= how.min_words), key=lambda x: (-x[4], x[0] is None, x[0]))
    for k, x in enumerate(able[: how.percent * len(able) // 100]):
        x[5] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("how", [targets.Target(), targets.Target(buckets=97, n_grams=3, percent=40, min_words=5, blocks=7, part_rows=40)])
def test_draw_towards_is_the_brute_force_one(spark, how):
    rows, items = some_rows(230, 3) + ODD, [t for _, t in some_rows(12, 9)]
    got = targets.draw_towards(table(spark, rows, extra=True), table(spark, list(enumerate(items))), how).collect()
    assert Counter(map(tuple, got)) == brute_draw(rows, items, how)


def test_draw_of_nothing(spark):
    none = table(spark, some_rows(5, 1)).where("doc_id < 0")
    assert targets.draw_towards(none, table(spark, some_rows(5, 1))).collect() == []
    got = targets.draw_towards(table(spark, some_rows(50, 1)), none)
    assert Counter(map(tuple, got.collect())) == brute_draw(some_rows(50, 1), [], targets.Target())


def test_long_texts_are_cut_between_words(monkeypatch):
    text, how = some_rows(1, 5)[0][1] * 40, targets.Target(n_grams=3)
    whole = targets.bucket_counts(text, how, targets._Crc(how.buckets))
    monkeypatch.setattr(targets, "_SLICE", 50)
    parts = targets.bucket_counts(text, how, targets._Crc(how.buckets))
    assert whole[0] == parts[0] and all((a == b).all() for a, b in zip(whole[1:], parts[1:], strict=True))


def test_numbers_are_a_total_order(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(500)], "a long, b long").repartition(5)
    got = sorted((r.number, r.a, r.b) for r in targets.numbered(rows, F.col("a").desc(), F.col("b")).collect())
    assert got == [(k + 1, a, b) for k, (a, b) in enumerate(sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1])))]


def check_law(found, rows, shards):
    counts = Counter(r.shard for r in found)
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    assert all(sorted(r.slot for r in found if r.shard == k) == list(range(counts[k])) for k in counts)
    assert max(counts.values(), default=0) - min((counts.get(k, 0) for k in range(shards)), default=0) <= 1 and set(counts) <= set(range(shards))


@pytest.mark.parametrize("shards", [1, 7, 16])
def test_shards_hold_every_row_and_the_law(spark, shards):
    rows = some_rows(300, 4) + ODD * 3 + [(77, "the same")] * 150
    check_law(sharding.write_shards(table(spark, rows), shards, bucket_rows=20).collect(), rows, shards)


def test_shards_of_files(spark, tmp_path):
    """Buckets follow from the hash of the file's row; a bucket is one range of the order; equal rows are scattered; a second run agrees."""
    rows = some_rows(400, 6) + [(1, "copy")] * 200
    place = str(tmp_path / "in")
    table(spark, rows).write.parquet(place)
    docs = spark.read.parquet(place)
    first, second = (sharding.write_shards(docs, 5, row_hash=sharding.file_row_hash(31), bucket_rows=64).select("doc_id", "text", "shard", "slot").collect() for _ in range(2))
    check_law(first, rows, 5)
    assert Counter(map(tuple, first)) == Counter(map(tuple, second))
    keyed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    buckets = -(-len(rows) // 64)
    seed = xxhash.xxh64_intdigest((31).to_bytes(4, "little"), 42)
    of = {}
    for r in keyed:
        h = xxhash.xxh64_intdigest(r.i.to_bytes(8, "little"), xxhash.xxh64_intdigest(r.f.encode(), seed))
        of.setdefault((h - (1 << 64) if h >> 63 else h) % buckets, []).append((r.doc_id, r.text))
    assert len(of) == buckets and max(map(len, of.values())) < 3 * 64
    order = [(r.doc_id, r.text) for r in sorted(first, key=lambda r: (r.shard, r.slot))]
    start = 0
    for b in range(buckets):
        assert Counter(order[start : start + len(of[b])]) == Counter(of[b]), b
        start += len(of[b])


def test_shard_files_are_in_order(spark, tmp_path):
    place = str(tmp_path / "out")
    sharding.write_shards(table(spark, some_rows(300, 8)), 3, bucket_rows=30, place=place)
    import pyarrow.parquet as pq

    for k in range(3):
        files = sorted(os.listdir(f"{place}/shard={k}"))
        assert [s for f in files if f.endswith(".parquet") for s in pq.ParquetFile(f"{place}/shard={k}/{f}").read(columns=["slot"]).column(0).to_pylist()] == list(range(100))


def test_permutations_are_even(spark):
    """Over many buckets of four, each record comes to each place about as often."""
    starts = spark.range(1200).select(F.col("id").cast("int").alias("bucket"), F.lit(4).cast("long").alias("n"), (F.col("id") * 4).alias("start"))
    seen = Counter((i, p - 4 * r.bucket) for r in sharding.shuffle_positions(starts, 1200, 5).collect() for i, p in enumerate(r.places))
    assert len(seen) == 16 and all(220 < n < 380 for n in seen.values())


def test_starts_of_many_buckets(spark):
    counts = spark.range(5000).select(F.col("id").cast("int").alias("bucket"), (F.col("id") % 5).alias("n"))
    got, at = {r.bucket: r.start for r in sharding.bucket_starts(counts).collect()}, 0
    for b in range(5000):
        assert got[b] == at
        at += b % 5


def test_shards_of_clashing_names_and_nothing(spark):
    got = sharding.write_shards(table(spark, some_rows(20, 2), extra=True), 4)
    assert {"input_shard", "input_slot", "shard", "slot", "weight"} <= set(got.columns) and {r.input_shard for r in got.collect()} == {"shard"}
    assert sharding.write_shards(table(spark, some_rows(3, 2)).where("doc_id < 0"), 4).collect() == []
    assert free_names(["a", "B", "input_b"], ["A", "b"]) == {"a": "input_a", "B": "input_B", "input_b": "input_input_b"}


def brute_middle(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, d = len(units), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, None, text)
    return (i, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (i, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_is_the_brute_force_one(spark):
    rows = some_rows(300, 7) + ODD
    found = middle.fill_in_middle(table(spark, rows, extra=True), keep=["doc_id", "form", "text"])
    assert found.columns == ["doc_id", "input_form", "text", "n", "form", "prefix", "middle", "suffix", "output"]
    found = found.withColumn("restored", middle.restore(F.col("output"), F.col("form"))).collect()
    assert all(r.restored == (r.text or "") and r.input_form == "form" for r in found)
    assert Counter((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in found) == Counter(brute_middle(*r) for r in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("grammar", "pattern"), [(middle.CHARACTERS, r"(?s)."), (middle.LETTER_RUNS, r"[A-Za-z]+|[^A-Za-z]"), (middle.WORDS_AND_SPACE, r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), (middle.LINES, r"[^\n]*\n|[^\n]+")])
def test_units_of_grammars(spark, grammar, pattern):
    rows = [*some_rows(20, 11), *ODD]
    got = table(spark, rows).select("text", grammar.units(F.col("text")).alias("u")).collect()
    assert all(r.u == re.findall(pattern, r.text or "") and "".join(r.u) == (r.text or "") for r in got)


def test_other_markers(spark):
    how = middle.FillInMiddle(percent=100, spm_percent=50, markers=("[p.", "$1s", "(m|"), grammar=middle.WORDS_AND_SPACE)
    rows = [*some_rows(40, 12), (500, "it has [p. in it"), (501, "back\\slash $2 {x}")]
    found = middle.fill_in_middle(table(spark, rows), ["text"], how).withColumn("r", middle.restore(F.col("output"), F.col("form"), how.markers)).collect()
    assert all(r.r == r.text for r in found) and [r.form for r in found if "[p." in r.text] == ["plain"] and {r.form for r in found} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(table(spark, rows).where("doc_id < 0")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_shards_query(spark):
    found = queries.QUERIES["op12_shards"](spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(found) == len(docs) and all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in found)
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == k) == list(range(counts[k])) for k in counts)
