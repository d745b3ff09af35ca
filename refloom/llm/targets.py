"""Importance resampling towards a target corpus, by bucket-partitioned inverted postings.

Every feature of a text (a run of words) falls into a bucket. Postings (bucket, document, count) are shuffled by bucket, to
where the bucket's counts in both corpora are; its gain is computed there and the contributions that postings make with
it are summed by document. Postings of neighbouring buckets of one document travel as one row, so that a row is
arrays of numbers and not a single count; a block of buckets is split by documents into parts of bounded size, so a
bucket that every document has is no larger task than any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.llm.shared import materialize
from refloom.llm.text import CACHED_WORDS, rows_of

#: Bytes of words: digits, letters (lower-cased) and all of a character beyond ASCII; the others become spaces.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))
#: Bytes of a text that are cut into words at a time.
_SLICE = 1 << 20


@dataclass(frozen=True)
class Target:
    """Features are runs of 1 to n_grams words, in so many buckets; the percent of documents with min_words words that are drawn; seed goes into the hash of the id. blocks: of buckets; part_rows: documents to a block's part, on average."""

    buckets: int = 10_000
    n_grams: int = 1
    min_words: int = 20
    percent: int = 10
    seed: int = 2024
    blocks: int = 16
    part_rows: int = 1 << 14

    @property
    def width(self) -> int:
        """Buckets of a block."""
        return -(-self.buckets // self.blocks)


class _Crc(dict):
    """Word to the bucket of its CRC-32, remembered for frequent words."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = zlib.crc32(word) % self.buckets
        return found


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    start = 0
    while start < len(data):
        end = start + _SLICE
        if end < len(data):
            cut = data.find(b" ", end)
            end = cut if cut >= 0 else len(data)
        yield data[start:end].split()
        start = end


def bucket_counts(text: str | None, how: Target, crc: _Crc) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words of a text, its buckets (ascending) and the number of features in each."""
    n_words, found, tail = 0, [], []
    for words in word_slices(text):
        n_words += len(words)
        found.append(np.fromiter(map(crc.__getitem__, words), np.int32, len(words)))
        if how.n_grams > 1:
            several = [*tail, *words]
            for n in range(2, how.n_grams + 1):
                # runs that end among the new words
                first = max(0, len(tail) - n + 1)
                runs = [b" ".join(several[i : i + n]) for i in range(first, len(several) - n + 1)]
                found.append(np.fromiter((zlib.crc32(x) % how.buckets for x in runs), np.int32, len(runs)))
            tail = several[-(how.n_grams - 1) :]
    buckets, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    return n_words, buckets, counts


def _postings(found: list[tuple[np.ndarray, np.ndarray]], how: Target) -> pa.Array:
    """Of each text its postings, a list of blocks with the places in the block and their counts."""
    sizes = np.array([len(b) for b, _ in found], np.int64)
    buckets = np.concatenate([b for b, _ in found]) if found else np.zeros(0, np.int32)
    counts = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
    text, block = np.repeat(np.arange(len(found)), sizes), buckets // how.width
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(block) != 0)))) if len(text) else np.zeros(0, np.int64)
    inner = pa.array(np.append(begins, len(buckets)).astype(np.int32))
    places = pa.ListArray.from_arrays(inner, pa.array((buckets % how.width).astype(np.int32)))
    each = pa.ListArray.from_arrays(inner, pa.array(counts.astype(np.int32)))
    rows = pa.StructArray.from_arrays([pa.array(block[begins].astype(np.int32)), places, each], names=["block", "places", "counts"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[begins], np.arange(len(found) + 1)).astype(np.int32)), rows)


def features(texts: DataFrame, how: Target) -> DataFrame:
    """(at, text, and any other columns) to the columns without text, n_words, n_features and postings array<struct<block, places, counts>>."""
    others = [f for f in texts.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "n_words long, n_features long, postings array<struct<block:int,places:array<int>,counts:array<int>>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = _Crc(how.buckets)
        for batch in batches:
            found = [bucket_counts(t, how, crc) for (t,) in rows_of(batch, "text")]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in others]
            numbers = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([int(c.sum()) for _, _, c in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *numbers, _postings([(b, c) for _, b, c in found], how)], names=[*(f.name for f in others), "n_words", "n_features", "postings"])

    return texts.mapInArrow(run, schema)


def bucket_sums(postings: DataFrame, name: str) -> DataFrame:
    """(block, places, counts) to block, place, and the sum of counts: partial sums in every task, so at most all buckets a task are shuffled."""
    return postings.select("block", F.inline(F.arrays_zip("places", "counts"))).groupBy("block", F.col("places").alias("place")).agg(F.sum("counts").alias(name))


def block_gains(own: DataFrame, target: DataFrame, how: Target) -> DataFrame:
    """block, gains: of each bucket of the block floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).

    s and S are the bucket's and all features in the corpus, t and T those in the target corpus. There are as many rows
    before the grouping as buckets, whatever the size of the corpora.
    """
    spark = own.sparkSession
    every = spark.range(how.buckets).select(F.expr(f"cast(id div {how.width} as int)").alias("block"), F.expr(f"cast(id % {how.width} as int)").alias("place"))
    both = every.join(bucket_sums(own, "s"), ["block", "place"], "left").join(bucket_sums(target, "t"), ["block", "place"], "left").fillna(0, ["s", "t"])
    all_buckets = Window.partitionBy()
    counts = {k: F.col(k).cast("double") for k in ("s", "t")} | {k.upper(): F.sum(k).over(all_buckets).cast("double") for k in ("s", "t")}
    ratio = (counts["t"] + 1) * (counts["S"] + how.buckets) / ((counts["s"] + 1) * (counts["T"] + how.buckets))
    gains = both.select("block", "place", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))
    return gains.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "gain"))).getField("gain").alias("gains"))


def floor_div(a: Column, b: Column) -> Column:
    """a / b, rounded down, in whole numbers."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def weigh(docs: DataFrame, target: DataFrame, how: Target = Target()) -> DataFrame:
    """at (a number of the row), doc_id, n_words, n_features and weight of each row of docs: the mean gain of its features, rounded down; 0 without features."""
    rows = docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", F.col("text").cast("string").alias("text"))
    found = materialize(features(rows, how), "target-features")
    wanted = features(target.select(F.col("text").cast("string").alias("text")), how)
    gains = block_gains(found.select(F.inline("postings")), wanted.select(F.inline("postings")), how)
    parts = max(1, -(-found.count() // how.part_rows))
    # each part of a block meets its own copy of the block's gains; by hash at every size, since gains are arrays of bounded length
    copies = gains.select("block", "gains", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    postings = found.select("at", F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int").alias("part"), F.inline("postings"))
    met = postings.join(copies.hint("shuffle_hash"), ["block", "part"])
    one = F.aggregate(F.arrays_zip("places", "counts"), F.lit(0).cast("long"), lambda total, x: total + x["counts"] * F.get("gains", x["places"]))
    given = met.select("at", one.alias("gain")).groupBy("at").agg(F.sum("gain").alias("gain"))
    known = found.select("at", "doc_id", "n_words", "n_features")
    joined = known.join(given.hint("merge"), "at", "left")
    weight = F.when(F.col("n_features") > 0, floor_div(F.col("gain"), F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    return joined.select("at", "doc_id", "n_words", "n_features", weight.alias("weight"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), with u from the first eight hexadecimal digits of sha256("seed:doc_id"); a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with number, 1, 2, 3... in a total order: ranges are dealt out and sorted, a row's number follows from its place in its range and the sizes of the ranges before, which are as many as partitions."""
    spark = rows.sparkSession
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # the identity of a row is its partition's number in the upper bits, its place in it in the lower 33
    dealt = rows.repartitionByRange(many, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("__range", F.shiftright("__place", 33).cast("int")), "target-order")
    sizes = dealt.groupBy(F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialize(sizes.select("__r", before.alias("__before")), "target-ranges")
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(sizes, F.col("__range") == F.col("__r")).withColumn("number", F.col("__before") + within + 1).drop("__place", "__range", "__r", "__before")


def draw_towards(docs: DataFrame, target: DataFrame, how: Target = Target()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of each row of docs.

    Of the N rows with min_words words, floor(percent * N / 100) with the highest scores are drawn; ties go to the
    smaller doc_id (null last), then to either row. A null text counts as empty; texts without words have weight 0. Rows
    with equal id and text have equal scores, and each counts. Without target texts T is 0 and frequent buckets lose;
    an empty table gives an empty one; other columns play no part.
    """
    weighed = weigh(docs, target, how)
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), how.seed)).withColumn("able", F.col("n_words") >= how.min_words)
    scored = materialize(scored, "target-scores")
    k = how.percent * scored.where("able").count() // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at")]
    rank = F.when(F.col("able") & (F.col("number") <= k), F.col("number"))
    return numbered(scored, *order).select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op11_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = draw_towards(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC-32 of a word is folded over its bytes, once for each distinct word; its table follows from the polynomial.
OP11_SQL = r"""
with recursive bits as (
  select range::bigint as i, range::bigint as c, 0 as k from range(256)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crcs as (select list(c order by i) as t from bits where k = 8),
texts as (
  select 'd' as corpus, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all
  select 'b', null, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
words as (
  select corpus, doc_id, w, count(*) as n
  from (select corpus, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from texts) group by all),
vocabulary as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::bigint, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket
  from (select distinct w from words), crcs),
counted as (select corpus, doc_id, bucket, sum(n)::bigint as n from words join vocabulary using (w) group by all),
sums as (select bucket, sum(case when corpus = 'd' then n else 0 end) as s, sum(case when corpus = 'b' then n else 0 end) as t from counted group by bucket),
totals as (select coalesce(sum(s), 0)::double as ss, coalesce(sum(t), 0)::double as tt from sums),
gains as (select bucket, floor(1000.0 * ln((t + 1)::double * (ss + 10000) / ((s + 1)::double * (tt + 10000))))::bigint as gain from sums, totals),
weighed as (select doc_id, sum(n)::bigint as f, sum(n * gain)::bigint as g from counted join gains using (bucket) where corpus = 'd' group by doc_id),
scored as (
  select d.doc_id, coalesce(f, 0) as n_features, case when f > 0 then (g - ((g % f) + f) % f) // f else 0 end as weight,
    floor(-1000.0 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::varchar), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint as noise
  from documents d left join weighed using (doc_id)),
ranked as (
  select doc_id, n_features, weight, weight + noise as score, row_number() over (partition by n_features >= 20 order by weight + noise desc, doc_id) as r,
    (count(*) filter (n_features >= 20) over ()) * 10 // 100 as k
  from scored)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when n_features >= 20 and r <= k then r end as rank from ranked
"""
