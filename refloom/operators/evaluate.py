"""Results against a gold standard: verdicts, metrics, tables and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.doi import all_dois, normalize_doi, normalize_id
from refloom.functions.student import two_sided
from refloom.functions.text import present

#: Names in reports.
DISPLAY = {"openalex": "OpenAlex", "openaire": "OpenAIRE", "pubmed": "PubMed", "crossref": "CrossRef", "hal": "HAL", "ensemble": "Ensemble"}


def read_gold(spark, path: str) -> DataFrame:
    """A JSON object from citation to expected identifiers, as rows in its order: position (from 0), citation, doi, openalex, openaire, pubmed, crossref, hal."""
    kind = "map<string,struct<doi: string, openalex: string, openaire: string, pubmed: string, crossref: string, hal: string>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.map_entries(F.from_json("value", kind))).alias("position", "x")).select("position", F.col("x.key").alias("citation"), "x.value.*")


def read_results(spark, path: str, array: bool = False) -> DataFrame:
    """Results of earlier runs, one JSON object per line or, with array, a JSON array; no such file gives an empty table, and what isn't JSON no rows."""
    kind = "citation_id string, api string, citation string, status string, score double, pub_id string, main_doi string, alternative_dois array<string>, apa string, final_evaluation string"
    try:
        return spark.read.schema(kind).option("multiLine", array).option("mode", "DROPMALFORMED").json(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], kind)


def final_evaluation(api: Column, status: Column, pub_id: Column, main_doi: Column, alternatives: Column, expected_doi: Column, expected_id: Column, metadata_match: Column, loose: bool = False) -> Column:
    """CORRECT, INCORRECT or ERROR. expected_id: the gold identifier at this source (the DOI for CrossRef and the ensemble)."""
    want = normalize_doi(expected_doi)
    is_ensemble, by_doi = api == "ensemble", api.isin("crossref", "ensemble")
    expected = present(F.when(by_doi, expected_doi).otherwise(expected_id))
    dois = all_dois(main_doi, alternatives)
    # most results have no alternatives, so the main DOI is compared by itself
    other_hit = F.when(F.size(alternatives) > 0, F.exists(alternatives, lambda d: normalize_doi(d) == want))
    doi_hit = F.coalesce(normalize_doi(main_doi) == want, F.lit(False)) | F.coalesce(other_hit, F.lit(False))
    id_hit = F.coalesce(~by_doi & (normalize_id(api, expected_id) == normalize_id(api, pub_id)), F.lit(False))
    word = lambda ok: F.when(ok, "CORRECT").otherwise("INCORRECT")
    found = (F.size(dois) > 0) | present(pub_id).isNotNull()
    # a stray main DOI counts for the ensemble, no identifier does
    ensemble = F.when(present(expected_doi).isNotNull() & present(main_doi).isNotNull(), word(F.coalesce(normalize_doi(main_doi) == want, F.lit(False)))).otherwise(word(present(expected_doi).isNull() & present(main_doi).isNull()))
    likely = F.coalesce(metadata_match == "LIKELY_SAME", F.lit(False))
    single = F.when(doi_hit | id_hit, "CORRECT").when(likely, "CORRECT" if loose else "INCORRECT").when(found | present(expected_doi).isNotNull() | expected.isNotNull(), "INCORRECT").otherwise("ERROR")
    return F.when(status == "ERROR", "ERROR").when(status == "NO_RESULT", word(expected.isNull())).when(is_ensemble, ensemble).otherwise(single)


def evaluate(results: DataFrame, gold: DataFrame, loose: bool = False) -> DataFrame:
    """Adds expected, final_evaluation and gold_doi to results (citation, api, status, pub_id, main_doi, alternative_dois) of citations in gold."""
    ids = F.create_map(*(x for a in ("openalex", "openaire", "pubmed", "hal") for x in (F.lit(a), F.col(f"g_{a}"))))
    g = gold.select(F.col("citation").alias("g_citation"), F.col("doi").alias("g_doi"), *(F.col(a).alias(f"g_{a}") for a in ("openalex", "openaire", "pubmed", "hal")))
    rows = results.join(g, F.col("citation") == F.col("g_citation"))
    own = F.when(F.col("api").isin("crossref", "ensemble"), F.col("g_doi")).otherwise(F.try_element_at(ids, F.col("api")))
    meta = F.col("metadata_match") if "metadata_match" in results.columns else F.lit(None).cast("string")
    verdict = final_evaluation(F.col("api"), F.col("status"), F.col("pub_id"), F.col("main_doi"), F.col("alternative_dois"), F.col("g_doi"), own, meta, loose)
    return rows.select(*(c for c in results.columns if c != "gold_doi"), present(own).alias("expected"), verdict.alias("final_evaluation"), present(F.col("g_doi")).alias("gold_doi"))


def metrics(evaluated: DataFrame, apis: Sequence[str] = tuple(DISPLAY)) -> DataFrame:
    """Counts and accuracy per approach, a row for each of apis even without results; errors don't count."""
    ok, has, want = F.col("final_evaluation") == "CORRECT", F.col("status") == "RESULT", F.col("expected").isNotNull()
    # errors are left out by counting, not by a filter, in which the verdict would be worked out once more
    count = lambda c: F.coalesce(F.count_if((F.col("final_evaluation") != "ERROR") & c), F.lit(0))
    per = evaluated.groupBy("api").agg(
        count(F.lit(True)).alias("total"), count(ok).alias("correct"), count(ok & has).alias("correct_match"), count(ok & ~has).alias("correct_no_result"), count(~ok).alias("incorrect"),
        count(~ok & has & want).alias("incorrect_match"), count(~ok & ~has & want).alias("incorrect_missing"), count(~ok & has & ~want).alias("incorrect_spurious"),
    )
    seed = evaluated.sparkSession.createDataFrame([(a,) for a in apis], "api string")
    names = [c for c in per.columns if c != "api"]
    out = seed.join(per, "api", "left").select("api", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names))
    return out.withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))


def comparison(evaluated: DataFrame, apis: Sequence[str] = tuple(DISPLAY)) -> DataFrame:
    """One row per citation: the citation, cut at 80 characters, and each approach's verdict and DOI."""
    short = F.when(F.length("citation") > 80, F.concat(F.substr("citation", F.lit(1), F.lit(80)), F.lit("..."))).otherwise(F.col("citation"))
    cells = evaluated.groupBy("citation_id", short.alias("citation")).pivot("api", list(apis)).agg(F.max("final_evaluation").alias("Status"), F.max("main_doi").alias("DOI"))
    return cells.select("citation_id", "citation", *(F.coalesce(f"{a}_{k}", F.lit("")).alias(f"{DISPLAY.get(a, a)}_{k}") for a in apis for k in ("Status", "DOI")))


def details(evaluated: DataFrame, api: str) -> DataFrame:
    """An approach's rows as its own table: twelve columns of a source's result, seven of the ensemble's. What evaluated doesn't have is empty."""
    has = lambda c: F.col(c) if c in evaluated.columns else F.lit(None).cast("string")
    head = {"Citation_ID": F.col("citation_id"), "Citation": F.col("citation"), "Gold_DOI": has("gold_doi")}
    tail = {"Status": F.col("status"), "Final_Evaluation": F.col("final_evaluation")}
    if api == "ensemble":
        own = {"Consensus_DOI": F.col("main_doi"), "External_IDs": F.to_json("external_ids") if "external_ids" in evaluated.columns else has("external_ids")}
        columns = head | own | tail
    else:
        dois = all_dois(F.col("main_doi"), F.col("alternative_dois"))
        own = {f"Gold_{DISPLAY.get(api, api)}_ID": F.col("expected"), "Retrieved_ID": F.col("pub_id"), "Main_DOI": F.col("main_doi"), "Alternative_DOIs": F.array_join("alternative_dois", "; "), "Total_DOIs": F.size(dois), "Score": has("score")}
        columns = head | own | tail | {"Formatted_Citation": has("apa")}
    return evaluated.where(F.col("api") == api).select(*(c.alias(k) for k, c in columns.items()))


def dashboard(measured: DataFrame) -> DataFrame:
    """Metrics as lines of a fixed-width table, in the order of approaches: no, line."""
    order = F.array_position(F.array(*map(F.lit, DISPLAY)), F.col("api"))
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in DISPLAY.items() for x in kv)), F.col("api")), F.col("api"))
    cells = [F.rpad(name, 12, " "), *(F.lpad(F.col(c).cast("string"), 10, " ") for c in ("total", "correct", "correct_match", "correct_no_result", "incorrect", "incorrect_match", "incorrect_missing", "incorrect_spurious")), F.lpad(F.format_number("accuracy", 3), 10, " ")]
    return measured.select(order.cast("int").alias("no"), F.concat(*cells).alias("line"))


def save_reports(evaluated: DataFrame, place: str, apis: Sequence[str] = tuple(DISPLAY), mode: str = "strict") -> list[str]:
    """Writes dashboard, metrics, comparison, details per approach and raw results below place; gives the folders' names."""
    measured = metrics(evaluated, apis)
    head = evaluated.sparkSession.createDataFrame([(-1, f"Evaluation mode: {mode}")], "no int, line string")
    tsv = {"header": True, "sep": "\t"}
    out = [f"{place}/01_summary", f"{place}/02_metrics", f"{place}/03_comparison", *(f"{place}/04_{a}" for a in apis), f"{place}/05_results"]
    head.unionByName(dashboard(measured)).coalesce(1).sortWithinPartitions("no").select("line").write.mode("overwrite").text(out[0])
    measured.coalesce(1).write.mode("overwrite").options(**tsv).csv(out[1])
    comparison(evaluated, apis).write.mode("overwrite").options(**tsv).csv(out[2])
    for a, to in zip(apis, out[3:-1]):
        details(evaluated, a).write.mode("overwrite").options(**tsv).csv(to)
    evaluated.write.mode("overwrite").json(out[-1])
    return out


def precision_recall(pairs: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, specificity, f1 of two boolean columns; shares without cases are 0."""
    p, a = F.coalesce(F.col(predicted), F.lit(False)), F.coalesce(F.col(actual), F.lit(False))
    n = pairs.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    n = n.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "specificity": share(F.col("tn"), F.col("tn") + F.col("fp"))})
    return n.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibration(rows: DataFrame, score: str, correct: str, bins: int = 10) -> DataFrame:
    """Equal bins of a score from 0 to under 1: bin, n, mean_score, accuracy, gap, weight (its share of all rows in bins)."""
    b = F.floor(F.col(score) * bins).cast("int")
    per = rows.where((F.col(score) >= 0) & (F.col(score) < 1)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    total = per.agg(F.sum("n").alias("all_n"))
    return per.crossJoin(F.broadcast(total)).select("bin", "n", "mean_score", "accuracy", F.abs(F.col("mean_score") - F.col("accuracy")).alias("gap"), (F.col("n") / F.col("all_n")).alias("weight"))


def expected_error(calibrated: DataFrame) -> DataFrame:
    """One row: ece (weighted mean gap) and mce (largest gap) of calibrated bins."""
    return calibrated.agg(F.coalesce(F.sum(F.col("gap") * F.col("weight")), F.lit(0.0)).alias("ece"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("mce"))


def compare_runs(a: DataFrame, b: DataFrame, correct: str = "correct") -> DataFrame:
    """Two runs' accuracies and Welch's test of their difference: n_a, n_b, accuracy_a, accuracy_b, difference, t, freedom, p_value (two-sided); the last three null without variance."""
    one = lambda df, s: df.agg(F.count(F.lit(1)).alias(f"n_{s}"), F.avg(F.col(correct).cast("double")).alias(f"accuracy_{s}"), F.var_samp(F.col(correct).cast("double")).alias(f"v_{s}"))
    both = one(a, "a").crossJoin(one(b, "b")).withColumns({f"e_{s}": F.col(f"v_{s}") / F.col(f"n_{s}") for s in "ab"})
    e_a, e_b = F.col("e_a"), F.col("e_b")
    both = both.withColumn("t", F.try_divide(F.col("accuracy_b") - F.col("accuracy_a"), F.sqrt(e_a + e_b)))
    both = both.withColumn("freedom", F.try_divide((e_a + e_b) * (e_a + e_b), F.try_divide(e_a * e_a, F.col("n_a") - 1) + F.try_divide(e_b * e_b, F.col("n_b") - 1)))
    return both.select("n_a", "n_b", "accuracy_a", "accuracy_b", (F.col("accuracy_b") - F.col("accuracy_a")).alias("difference"), "t", "freedom", two_sided(F.col("t"), F.col("freedom")).alias("p_value"))
