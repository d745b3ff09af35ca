"""Shared folders."""

import os

import pytest

from refloom.sources import storage


class Fake:
    """A session of a cluster without a shared folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda name, default: default)

    class sparkContext:  # noqa: N801
        master = "yarn"


def test_a_path_without_scheme_gets_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_named", lambda _: str(tmp_path / "shared"))
    assert storage.shared_dir(spark) == f"file://{tmp_path}/shared"
    table = storage.materialize(spark.range(5), "t")
    assert table.count() == 5 and len(os.listdir(tmp_path / "shared")) == 1


def test_one_machine_makes_its_own_folder(spark, monkeypatch):
    monkeypatch.setattr(storage, "_named", lambda _: None)
    assert storage.shared_dir(spark) == storage.shared_dir(spark) and storage.shared_dir(spark).startswith("file:///")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Fake)


def test_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_named", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(storage, "_MADE", [])
    storage.materialize(spark.range(3), "t")
    storage.settled(spark.range(3))
    assert len(os.listdir(tmp_path)) == 2 and storage.remove_places(spark) == 2 and os.listdir(tmp_path) == []


def test_scratch_tables_go_at_its_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_named", lambda _: f"file://{tmp_path}/shared")
    monkeypatch.setattr(storage, "_MADE", [])
    kept = storage.settled(spark.range(2))
    with pytest.raises(RuntimeError), storage.scratch(spark):
        storage.settled(spark.range(3))
        raise RuntimeError("in the middle")
    with storage.scratch(spark):
        assert storage.settled(spark.range(4)).count() == 4 and len(os.listdir(tmp_path / "shared")) == 2
    assert len(os.listdir(tmp_path / "shared")) == 1 and kept.count() == 2


def test_a_finished_stream_leaves_no_tables(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from refloom.plans.engine import Engine
    from refloom.sources.payloads import PUBLICATION
    from refloom.streaming.link import link_stream

    monkeypatch.setattr(storage, "_named", lambda _: f"file://{tmp_path}/shared")
    monkeypatch.setattr(storage, "_MADE", [])
    row = ("openalex", "W1", "A fine title of words", ["Smith, J."], "2001", "Journal of Tests", None, "3", "4", "10", "20", None, "10.1000/abc", [])
    engine = Engine({"openalex": spark.createDataFrame([row], PUBLICATION)})
    spark.createDataFrame([(1, "Smith, J. (2001). A fine title of words. Journal of Tests, 3 (4) 10-20.")], "citation_id long, citation string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("citation_id long, citation string").parquet(f"{tmp_path}/in")
    link_stream(stream, engine, "openalex", f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert [r.pub_id for r in spark.read.parquet(f"{tmp_path}/out").select(F.col("pub_id")).collect()] == ["W1"] and os.listdir(tmp_path / "shared") == []


def test_what_was_shuffled_for_a_table_goes_with_its_writing(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(storage, "_named", lambda _: f"file://{tmp_path}")
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    setting = spark.conf.get(storage._CLEANUP)
    before = held()
    table = storage.materialize(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n")), "t")
    assert held() <= before and table.count() == 100 and spark.conf.get(storage._CLEANUP) == setting
