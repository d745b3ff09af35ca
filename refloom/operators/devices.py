"""Where a model's work runs: executors with the devices that it asks for, and what it falls back to in a worker.

Two things are apart. Placement is Spark's: a stage of mapInArrow may carry a resource profile, so that its tasks go to
executors with a device and share it as asked, while the stages before and after keep the plain executors. Fall-back is the
worker's: a loader is tried with one device after the other, and the first that loads is used by all batches of the task.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from refloom.operators.backends import RAW_TYPE, SPANS, ModelBackend

CPU = "cpu"
#: Masters that can start executors of another profile.
_PROFILED = ("yarn", "k8s", "spark://", "local-cluster")


def device_profile(resource: str = "gpu", tasks_per_device: int = 4, cores: int = 4, memory: str | None = None, script: str = "") -> ResourceProfile:
    """Executors with one device, shared by tasks_per_device tasks. script: finds the device's addresses on a host, where the cluster manager needs one."""
    executor = ExecutorResourceRequests().cores(cores).resource(resource, 1, script)
    if memory:
        executor = executor.memory(memory)
    task = TaskResourceRequests().cpus(1).resource(resource, 1 / tasks_per_device)
    return ResourceProfileBuilder().require(executor).require(task).build


def profile_for(spark: SparkSession, wanted: ResourceProfile | None) -> ResourceProfile | None:
    """wanted, where the session's master can start executors for it and is allowed to (dynamic allocation); else None: the stage then keeps the plain executors, and workers fall back."""
    context = spark.sparkContext
    allowed = context.getConf().get("spark.dynamicAllocation.enabled", "false") == "true"
    return wanted if wanted is not None and allowed and context.master.startswith(_PROFILED) else None


def task_devices(kind: str = "cuda", resource: str = "gpu") -> list[str]:
    """The devices to try in this worker: the address that Spark gave the task, or what the worker's environment shows, then the CPU."""
    from pyspark import TaskContext

    context = TaskContext.get()
    given = context.resources().get(resource) if context else None
    if given:
        return [*(f"{kind}:{a}" for a in given.addresses), CPU]
    seen = os.environ.get("CUDA_VISIBLE_DEVICES", "") if kind == "cuda" else ""
    return [*(f"{kind}:{i}" for i, _ in enumerate(x for x in seen.split(",") if x.strip() not in ("", "-1"))), CPU]


def load_first(load: Callable, devices: Sequence[str]) -> tuple[object, str]:
    """The model of load(device) and its device: the first of devices where it loads. What the loader closes over, such as a model's own path, is the same for each. The last one's failure is raised."""
    for k, device in enumerate(devices):
        try:
            return load(device), device
        except Exception as e:
            if k + 1 == len(devices):
                raise
            logging.getLogger(__name__).warning("no model on %s (%s: %s), trying %s", device, type(e).__name__, e, devices[k + 1])
    raise ValueError("no device to try")


class PlacedBackend(ModelBackend):
    """A ModelBackend whose loaders take a device, on executors of a profile where there are such.

    devices: to try, in order; task_devices() in each worker unless given. Each stage of it adds the column model_device where
    report is true.
    """

    def __init__(self, profile: ResourceProfile | None = None, devices: Sequence[str] | None = None, report: bool = False, **loaders):
        super().__init__(**loaders)
        self.profile, self.devices, self.report = profile, devices, report

    def _stage(self, df: DataFrame, text: str, load: Callable, fields: list[T.StructField], cells: Callable) -> DataFrame:
        """df with fields added by a model on the column text; cells: of one answer, the fields' values."""
        size, devices, report = self.batch, self.devices, self.report
        kept = [f for f in df.schema.fields if f.name not in {x.name for x in fields} | {"model_device"}]
        added = [*fields, *([T.StructField("model_device", T.StringType())] if report else [])]
        schema = T.StructType([*kept, *added])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            model, device = load_first(load, devices if devices is not None else task_devices())
            for batch in batches:
                values = [v or "" for v in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                rows = [cells(x) for a in range(0, len(values), size) for x in model(values[a : a + size])]
                columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
                columns += [pa.array([device] * len(values), pa.string())] if report else []
                own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=[f.name for f in schema.fields])

        return df.mapInArrow(run, schema, profile=profile_for(df.sparkSession, self.profile))

    def _labelled(self, df: DataFrame, text: str, load: Callable, label: str, score: str) -> DataFrame:
        return self._stage(df, text, load, [T.StructField(label, T.BooleanType()), T.StructField(score, T.DoubleType())], lambda x: (bool(x[0]), float(x[1])))

    def classify(self, df: DataFrame, text: str) -> DataFrame:
        load = self.loaders["classify"]
        return self._labelled(df, text, load, "type_label", "type_score") if load else super().classify(df, text)

    def ner(self, df: DataFrame, text: str) -> DataFrame:
        load = self.loaders["ner"]
        kind = T._parse_datatype_string(RAW_TYPE)
        return self._stage(df, text, load, [T.StructField("entities", kind)], lambda x: (list(x.items()),)) if load else super().ner(df, text)

    def span(self, df: DataFrame, text: str) -> DataFrame:
        load = self.loaders["span"]
        return self._stage(df, text, load, [T.StructField("spans", SPANS)], lambda x: (list(x),)) if load else super().span(df, text)

    def match(self, df: DataFrame, similarity: str) -> DataFrame:
        """The model gets citation and candidate as one text, with [SEP] between; the table has columns citation and apa."""
        from pyspark.sql import functions as F

        load = self.loaders["match"]
        if not load:
            return super().match(df, similarity)
        return self._labelled(df.withColumn("__pair", F.concat_ws(" [SEP] ", "citation", "apa")), "__pair", load, "sel_label", "sel_score").drop("__pair")
