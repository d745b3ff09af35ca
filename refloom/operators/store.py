"""Results kept between runs: a versioned table of Parquet folders, with counts of hits, that several runs may write at once.

A version is one small file that lists the folders of its rows and the counts so far. A writer puts its rows into a folder
of its own and then publishes the version after the one that it saw, under a name that only one writer can take; one
that comes too late reads what the other published and tries again on top of it. A reader takes the last version and
isn't touched by what is published later.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refloom.operators.cache import evict
from refloom.sources.storage import settled

EMPTY = {"version": 0, "parts": [], "asked": 0, "hits": 0}


class ResultStore:
    """key: columns that identify a result. Rows are those of put with inserted_at, the time at which they were put (or their own)."""

    def __init__(self, spark: SparkSession, place: str, key: list[str], schema: str, limit: int | None = None):
        self.spark, self.key, self.schema, self.limit = spark, key, f"{schema}, inserted_at timestamp", limit
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        self.system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.place = self.system.makeQualified(path).toString().rstrip("/")
        self.system.mkdirs(self._path("versions"))

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.place, *parts]))

    def version(self, number: int | None = None) -> dict:
        """A published version, the last one unless given."""
        if number is None:
            number = max((int(f.getPath().getName()[1:]) for f in self.system.listStatus(self._path("versions")) if f.getPath().getName().startswith("v")), default=0)
        if not number:
            return EMPTY
        stream = self.system.open(self._path("versions", f"v{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, change: Callable[[dict], dict]) -> dict:
        while True:
            new = change(self.version())
            new["version"] = new.get("version", 0) + 1
            own, target = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"v{new['version']}")
            stream = self.system.create(own, False)
            stream.write(bytearray(json.dumps(new).encode()))
            stream.close()
            try:
                if self._take(own, target):
                    return new
            finally:
                self.system.delete(own, False)

    def _take(self, own, target) -> bool:
        """Whether the file could be given a name that nobody has taken. A rename refuses that in distributed file systems; a local one would overwrite, so there a link is made."""
        if self.place.startswith("file:"):
            try:
                os.link(own.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return not self.system.exists(target) and self.system.rename(own, target)

    def put(self, results: DataFrame) -> int:
        """Adds results; the newest of equal keys counts. Gives the version."""
        folder, names = f"part-{uuid.uuid4().hex}", StructType.fromDDL(self.schema).names
        own = results if "inserted_at" in results.columns else results.withColumn("inserted_at", F.current_timestamp())
        own.select(*names).write.parquet(f"{self.place}/{folder}")
        return self._publish(lambda v: v | {"parts": [*v["parts"], folder]})["version"]

    def rows(self, number: int | None = None) -> DataFrame:
        """The results of a version (the last one), one row per key; what is put later doesn't change it."""
        parts = self.version(number)["parts"]
        reader = self.spark.read.schema(self.schema)
        found = reader.parquet(*(f"{self.place}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], self.schema)
        others = [f for f in found.columns if f not in self.key]
        newest = found.groupBy(*self.key).agg(F.max_by(F.struct(*others), F.struct("inserted_at", F.xxhash64(*others))).alias("r"))
        return newest.select(*self.key, "r.*").select(*found.columns)

    def look_up(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with the key (and no other column of a result) to those that have a result, with it, and those that have none; both are counted as asked, the first as hits."""
        known, names = self.rows(), asked.columns
        other = known.select(F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}" if c in self.key else c) for c in known.columns))
        same = [F.col(c) == F.col(f"__{c}") for c in self.key]  # a null key has no result
        both = settled(asked.join(other, same, "left").drop(*(f"__{c}" for c in self.key)))
        n, hits = both.agg(F.count(F.lit(1)), F.count("__hit")).first()
        self._publish(lambda v: v | {"asked": v["asked"] + n, "hits": v["hits"] + hits})
        return both.where("__hit").drop("__hit"), both.where("__hit is null").select(*names)

    def stats(self) -> DataFrame:
        """One row: version, entries, entry_limit, asked, hits, misses, rate (as text with one decimal)."""
        v = self.version()
        rate = F.concat(F.format_number(F.coalesce(100 * F.try_divide(F.col("hits"), F.col("asked")), F.lit(0.0)), 1), F.lit("%"))
        one = self.rows(v["version"]).agg(F.count(F.lit(1)).alias("entries"))
        one = one.select(F.lit(v["version"]).alias("version"), "entries", F.lit(self.limit).cast("long").alias("entry_limit"), F.lit(v["asked"]).cast("long").alias("asked"), F.lit(v["hits"]).cast("long").alias("hits"))
        return one.withColumn("misses", F.col("asked") - F.col("hits")).withColumn("rate", rate)

    def clear(self) -> int:
        """From the next version on there are no rows, and counts start anew; readers of earlier versions go on. Gives the version."""
        return self._publish(lambda v: EMPTY | {"version": v["version"]})["version"]

    def compact(self) -> int:
        """The rows as one part, the oldest left out where there are more than limit (see cache.evict); parts that others put meanwhile stay."""
        seen = self.version()
        rows = self.rows(seen["version"])
        folder = f"part-{uuid.uuid4().hex}"
        (rows if self.limit is None else evict(rows, self.limit)).write.parquet(f"{self.place}/{folder}")
        gone = set(seen["parts"])
        # a clear() in between wins
        return self._publish(lambda v: v | {"parts": [folder, *(p for p in v["parts"] if p not in gone)] if gone <= set(v["parts"]) else v["parts"]})["version"]

    def vacuum(self, keep: int = 1) -> int:
        """Deletes versions before the last `keep`, and folders that none of these lists, which nobody may be reading or writing any more; gives the number of folders."""
        last = self.version()["version"]
        kept = [self.version(n) for n in range(max(last - keep + 1, 1), last + 1)]
        used = {p for v in kept for p in v["parts"]}
        for n in range(1, last - keep + 1):
            self.system.delete(self._path("versions", f"v{n}"), False)
        names = [f.getPath().getName() for f in self.system.listStatus(self._path())]
        return sum(bool(self.system.delete(self._path(x), True)) for x in names if x.startswith("part-") and x not in used)
