"""Sharding by an external shuffle in two passes, in DataFrame operations only.

First pass: a seeded hash scatters the records over buckets of bounded size, whatever keys or texts they share. Second
pass: each bucket, one task of its own, is put into the order of a Fisher-Yates shuffle and written. A bucket's place in
the whole order is the number of records in the buckets before it; the order, cut into equal ranges, gives the shards.

What a task holds in memory is the permutation of a bucket (eight bytes a record). The records go through one exchange and
are sorted in their bucket, which spills, so neither long texts nor many equal ones need memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from refloom.llm.shared import free_names, materialize, new_place

SHARDS = 16
#: Records of a bucket, on average: 1 MB of permutation, and some 300 MB of records of 2 kB.
BUCKET_ROWS = 1 << 17
_BLOCK = 1024


def file_row_hash(seed: int) -> Column:
    """A seeded hash that tells rows apart, for tables that are read from files as they stand: of the file's name and the row's number in it."""
    return F.xxhash64(F.lit(seed), F.col("_metadata.file_name"), F.col("_metadata.row_index"))


def bucket_starts(counts: DataFrame) -> DataFrame:
    """(bucket, n) to bucket, n, start: how many records the buckets before it hold. Sums of blocks of buckets first, so that no task gets all buckets."""
    counts = counts.withColumn("block", F.floor(F.col("bucket") / _BLOCK))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select(F.col("block").alias("block2"), before(Window.orderBy("block")).alias("base"))
    within = counts.withColumn("within", before(Window.partitionBy("block").orderBy("bucket")))
    return within.join(blocks, F.col("block") == F.col("block2")).select("bucket", "n", (F.col("base") + F.col("within")).alias("start"))


def shuffle_positions(starts: DataFrame, buckets: int, seed: int) -> DataFrame:
    """bucket, places: the numbers start to start + n - 1 of each bucket, in the order of a Fisher-Yates shuffle.

    Spark's shuffle() is one, seeded with its seed and the number of the partition. Here each bucket is the only row of the
    partition that has its number, so a task that runs again draws the same permutation.
    """
    alone = starts.repartitionById(buckets, F.col("bucket"))
    return alone.select("bucket", F.shuffle(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1), seed).alias("places"))


def write_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 31, row_hash: Column | None = None, bucket_rows: int = BUCKET_ROWS, place: str | None = None) -> DataFrame:
    """The columns of docs with shard (0 to shards - 1) and slot (0, 1, 2... in the shard), written to place and read back.

    Law `rows`: the shards' counts of rows differ by one at most. Within place, a folder per shard holds Parquet files
    whose rows, file by file, are in the order of slots. row_hash tells rows apart and decides the order together with
    the seed; where it is None, docs is written first with a number for each row, so that repeated rows are scattered
    like any others and a lost task can't number them anew. Nulls, empty and long texts play no part in the order; an
    empty table gives an empty one; a column of docs that is named shard or slot is called input_shard or input_slot.
    """
    spark = docs.sparkSession
    names = free_names(docs.columns, ["shard", "slot"])
    if row_hash is None:
        docs = materialize(docs.select(F.struct(*(F.col(c).alias(names[c]) for c in docs.columns)).alias("record"), F.monotonically_increasing_id().alias("at")), "shard-rows")
        rows = docs.select(F.col("record.*"), F.xxhash64(F.lit(seed), F.col("at")).alias("__key"))
    else:
        rows = docs.select(*(F.col(c).alias(names[c]) for c in docs.columns), row_hash.alias("__key"))
    total = rows.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_rows))
    rows = rows.withColumn("__bucket", F.pmod(F.col("__key"), F.lit(buckets)).cast("int"))
    starts = bucket_starts(rows.groupBy(F.col("__bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    places = shuffle_positions(starts, buckets, seed)
    scattered = rows.repartitionById(buckets, F.col("__bucket"))
    numbered = scattered.withColumn("__i", F.row_number().over(Window.partitionBy("__bucket").orderBy("__key")))
    placed = numbered.join(places, F.col("__bucket") == F.col("bucket")).withColumn("__p", F.element_at("places", F.col("__i")))
    placed = placed.withColumn("shard", F.expr(f"__p * {shards} div {max(total, 1)}").cast("int"))
    slot = F.col("__p") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    out = placed.select(*names.values(), slot.alias("slot"), "shard").sortWithinPartitions("shard", "slot")
    place = place or new_place(spark, "shards")
    out.write.partitionBy("shard").parquet(place)
    own = [f for f in out.schema.fields if f.name not in ("shard", "slot")]
    return spark.read.schema(StructType(own).add("slot", LongType()).add("shard", IntegerType())).parquet(place)


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = write_shards(docs, row_hash=file_row_hash(31))
    text = F.coalesce(F.col("text"), F.lit(""))
    return found.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
