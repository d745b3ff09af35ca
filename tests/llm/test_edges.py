"""Clashing names, empty tables and long texts of the operators that the other tests leave out."""

import random

import pytest
from pyspark.sql import functions as F

from refloom.llm import decontaminate, html, quality, resample, toxicity, warc
from refloom.llm.shared import new_place

NAMES = ("score", "predicted", "shared", "item_id", "containment", "n_chars", "key", "kept", "log_ratio", "digest", "first", "mark", "refers_to", "payload", "u", "target", "__id", "__y", "h")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {i} " * (1 + 20_000 * (i == 3)) if i != 5 else None, "en", "s") for i in range(8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def clashing(frame):
    for name in NAMES:
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def test_other_columns_play_no_part(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    same = lambda run: sorted(map(repr, run(docs).collect())) == sorted(map(repr, run(clashing(docs)).collect()))
    assert same(lambda d: resample.resample(d, labels.where("quality = 1").select("doc_id"), 0.5))
    model = toxicity.fit_toxicity(toxicity.labelled_rows(clashing(docs), clashing(labels)))
    assert same(lambda d: toxicity.score_toxicity(d, model, ["doc_id"]))
    assert same(lambda d: decontaminate.find_items(d, spark.createDataFrame([(1, "text number 1 text")], "item_id long, text string")))
    assert quality.fit_references(clashing(docs), labels, least_documents=1) == quality.fit_references(docs, labels, least_documents=1)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert sorted(map(repr, html.extract(clashing(pages), ["page_id"]).collect())) == sorted(map(repr, html.extract(pages, ["page_id"]).collect()))
    archives = [warc.read_archives(warc.write_archives(p, new_place(spark, "w"))).select("page_id", "payload_digest", "record_type", "refers_to") for p in (pages, clashing(pages))]
    assert sorted(map(repr, archives[0].collect())) == sorted(map(repr, archives[1].collect()))


def test_names_of_the_result_are_refused(docs):
    named = clashing(docs)
    with pytest.raises(ValueError):
        toxicity.score_toxicity(named, toxicity.ToxicityModel(0.0, {}), ["doc_id", "score"])
    with pytest.raises(ValueError):
        decontaminate.find_items(named, docs.select(F.col("doc_id").alias("item_id"), "text"), ["doc_id", "shared"])
    with pytest.raises(ValueError):
        html.extract(named.withColumn("html", F.lit("x")), ["doc_id", "text"])


def test_empty_tables(spark, docs):
    none, labels = docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(toxicity.labelled_rows(none, labels)), ["doc_id"]).count() == 0
    assert html.extract(none.withColumn("html", F.lit("x")), ["doc_id"]).count() == 0
    assert quality.fit_references(none, labels) == {} and resample.resample(none, labels, 0.5).count() == 0


def test_the_sample_of_labelled_texts_is_bounded_by_characters(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    found = toxicity.labelled_rows(docs, labels, toxicity.ToxicityFit(fit_chars=100))
    assert 0 < len(found) < 8 and sum(len(t) for t, _ in found) <= 100


def test_a_too_long_text_is_left_out_alone(spark):
    """Wherever its hash falls, one text that hasn't room costs no other its place."""
    for k in range(6):
        rows = [(i, f"text {i} {k}") for i in range(20)] + [(99, f"{k} " * 5000)]
        labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
        found = toxicity.labelled_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels, toxicity.ToxicityFit(fit_chars=5000))
        usable = labels.where(~toxicity.held_out(F.col("doc_id"))).where("doc_id < 99").count()
        assert len(found) == usable > 5


def test_fit_is_a_plain_newton_solver(spark):
    """Weights of a small sample, by dense matrices over every swap of every sentence."""
    import numpy as np

    r = random.Random(4)
    bad, good, terms = ["vile", "scum", "rotten"], ["kind", "bright", "calm", "green"], {"group": ["people", "muslims", "women", "gay"]}
    rows = [(" ".join(r.choice(bad if label and r.random() < 0.5 else good) for _ in range(5)) + f" {r.choice(terms['group'])} n{i}", label) for i in range(120) for label in [int(r.random() < 0.4)]]
    rows = [(t.replace("people", "gay") if label and r.random() < 0.7 else t, label) for t, label in rows]
    how = toxicity.ToxicityFit(identity_terms=terms, least_z=1.5, counterfactual=2.0)
    model = toxicity.fit_toxicity(rows, how)
    assert len(model.weights) >= 3
    words = sorted(model.weights)
    x = np.array([[float(w.decode() in t.split()) for w in words] + [1.0] for t, _ in rows])
    y = np.array([label for _, label in rows], float)
    swapped = []
    for t, _ in rows:
        own = set(t.split())
        for term in own & set(terms["group"][1:]):
            for other in set(terms["group"]) - {term}:
                new = own - {term} | {other}
                swapped.append([float(w.decode() in own) - float(w.decode() in new) for w in words] + [0.0])
    change, ridge = np.array(swapped), np.diag([how.ridge] * len(words) + [1e-6])
    penalty = ridge + how.counterfactual * len(rows) / len(swapped) * change.T @ change
    w = np.zeros(len(words) + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
    assert [model.weights[k] for k in words] == pytest.approx(w[:-1].tolist(), abs=1e-6) and model.bias == pytest.approx(w[-1], abs=1e-6)


def test_a_long_page():
    page = "<body>" + "<div><p>The text of the page is in a paragraph of it.</p></div>" * 20_000
    assert html.main_text(page).count("\n") == 19_999
