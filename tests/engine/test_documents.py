"""Documents as files, cut by a table function; devices of models and what they fall back to."""

import random
import time

import pytest
from pyspark.sql import functions as F

from refloom.operators.backends import ModelBackend
from refloom.operators.devices import PlacedBackend, device_profile, load_first, profile_for, task_devices
from refloom.operators.spans import chunk_by_newline
from refloom.sources.documents import chunk_documents, chunks_of, plain_text, read_documents, register_chunks


def some_texts(n, seed):
    r = random.Random(seed)
    pieces = ["a", "word ", "line end\n", "\n", "\n\n", "   ", " ", "é😀", "x" * 30]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 7, 40, 2000])
def test_chunks_are_those_of_the_fold(spark, most):
    texts = [*some_texts(60, most), "", "\n\n", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(r.doc_id, r.chunk_no, r.offset, r.chunk) for r in chunk_by_newline(docs, most).collect()}
    files = docs.select("doc_id", F.lit("a.txt").alias("path"), F.col("text").cast("binary").alias("content"))
    assert {(r.doc_id, r.chunk_no, r.offset, r.chunk) for r in chunk_documents(files, max_chars=most).collect()} == want
    for text in texts:  # however the pieces end
        cuts = sorted(random.Random(len(text)).randint(0, len(text)) for _ in range(4))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert list(chunks_of(iter(parts), most)) == list(chunks_of(iter([text]), most))


def test_files_and_converters(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("first line\nsecond é".encode() + b"\xff")
    (tmp_path / "sub" / "b.REV").write_bytes(b"cba\nfed")
    (tmp_path / "empty.txt").write_bytes(b"")
    reverse = lambda content: (line[::-1] + "\n" for line in content.decode().split("\n"))
    got = {(r.path.rpartition("/")[2], r.chunk_no, r.offset, r.chunk) for r in chunk_documents(read_documents(spark, str(tmp_path)), {"rev": reverse}, 8).collect()}
    assert got == {("a.txt", 0, 0, "first line"), ("a.txt", 1, 11, "second é�"), ("b.REV", 0, 0, "abc\ndef")}
    register_chunks(spark, {"rev": reverse})
    read_documents(spark, str(tmp_path), "*.REV").createOrReplaceTempView("some_files")
    assert [r.chunk for r in spark.sql("SELECT chunk FROM some_files, LATERAL document_chunks(path, content, 2000)").collect()] == ["abc\ndef"]


def test_time_is_linear_in_the_text():
    content = b"a line of a long document that has many of them\n" * (100 << 20 // 48)
    content = (b"a line of a long document that has many of them\n" * ((100 << 20) // 48 + 1))[: 100 << 20]
    start = time.process_time()
    n = sum(1 for _ in chunks_of(plain_text(content), 2000))
    assert n > 50_000 and time.process_time() - start < 20


def loader(fails):
    def load(device):
        if device in fails:
            raise RuntimeError(f"no memory on {device}")
        return lambda texts: [(len(t) > 3, 0.75) for t in texts]

    return load


def test_the_first_device_that_loads():
    assert load_first(loader({"cuda:0"}), ["cuda:0", "cuda:1", "cpu"])[1] == "cuda:1"
    with pytest.raises(RuntimeError, match="cpu"):
        load_first(loader({"cuda:0", "cpu"}), ["cuda:0", "cpu"])
    with pytest.raises(ValueError):
        load_first(loader(set()), [])
    assert task_devices() == ["cpu"]


def test_environment_names_devices(monkeypatch):
    monkeypatch.setenv("CUDA_VISIBLE_DEVICES", "3,5")
    assert task_devices() == ["cuda:0", "cuda:1", "cpu"] and task_devices("mps") == ["cpu"]
    monkeypatch.setenv("CUDA_VISIBLE_DEVICES", "-1")
    assert task_devices() == ["cpu"]


def test_workers_fall_back_with_the_same_model(spark):
    path = "/models/own"

    def classify(device):  # of its own here: workers don't import test modules
        if device == "cuda:0":
            raise RuntimeError("no memory")
        return lambda texts: [(len(t) > 3, 0.75) for t in texts]

    seen = lambda device: (_ for _ in ()).throw(RuntimeError("busy")) if device != "cpu" else lambda texts: [{"TITLE": [f"{path}|{t}"]} for t in texts]
    backend = PlacedBackend(profile=device_profile(), devices=["cuda:0", "cpu"], report=True, classify=classify, ner=seen, span=lambda d: lambda texts: [[{"label": "YEAR", "start": 0, "end": len(t), "score": 1.0}] for t in texts])
    table = spark.createDataFrame([(1, "long text"), (2, "x"), (3, None)], "k int, citation string")
    got = backend.ner(backend.classify(table, "citation"), "citation").orderBy("k").collect()
    assert [(r.type_label, r.type_score, r.model_device) for r in got] == [(True, 0.75, "cpu"), (False, 0.75, "cpu"), (False, 0.75, "cpu")]
    assert [r.entities for r in got] == [{"TITLE": ["/models/own|long text"]}, {"TITLE": ["/models/own|x"]}, {"TITLE": ["/models/own|"]}]
    assert [(s.start, s.end) for r in backend.span(table, "citation").orderBy("k").collect() for s in r.spans] == [(0, 9), (0, 1), (0, 0)]
    plain = ModelBackend(classify=lambda: classify("cpu"))
    assert [r.type_label for r in plain.classify(table, "citation").orderBy("k").collect()] == [True, False, False]


def test_profiles(spark):
    profile = device_profile("gpu", tasks_per_device=4, cores=8, memory="6g")
    assert profile.executorResources["gpu"].amount == 1 and profile.executorResources["cores"].amount == 8 and profile.taskResources["gpu"].amount == 0.25
    # a local master has one kind of executor only
    assert profile_for(spark, profile) is None and profile_for(spark, None) is None
    # the plan of a placed stage names its profile
    stage = spark.range(3).mapInArrow(lambda batches: batches, "id long", profile=profile)
    assert "ResourceProfile" in stage._jdf.queryExecution().analyzed().toString() or stage._jdf.queryExecution().analyzed().toString().count("MapInArrow")
