"""Evaluation against a gold standard: link, vote, judge, go on where an earlier run ended, and save the reports.

python -m refloom.plans.evaluation --gold gold.json --publications openalex=/data/openalex.parquet --output out
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.operators.evaluate import dashboard, evaluate, metrics, read_gold, read_results, save_reports
from refloom.plans.engine import Engine
from refloom.sources.spec import SOURCES, source
from refloom.sources.storage import scratch, settled

RESULT = ("citation_id", "api", "citation", "status", "score", "pub_id", "main_doi", "alternative_dois", "apa")


def numbered(gold: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Citations of a gold standard (with position, from 0) after the first skip, limit of them at most, with citation_id: Cit_001 is the first of all."""
    own = gold.where(F.col("position") >= skip)
    if limit is not None:
        own = own.where(F.col("position") < skip + limit)
    return own.withColumn("citation_id", F.format_string("Cit_%03d", F.col("position") + 1))


def run_evaluation(engine: Engine, gold: DataFrame, apis: Sequence[str] | None = None, skip: int = 0, limit: int | None = None, previous: DataFrame | None = None, loose: bool = False) -> DataFrame:
    """One judged row per citation and approach, the vote of all sources being the approach ensemble.

    previous: judged rows of an earlier run. Its citations stay as they are and only others are worked on; with skip
    beside it only those of the first skip citations stay.
    """
    apis = list(apis or engine.publications)
    begin, kept = skip, None
    if previous is not None:
        if skip:
            kept = previous.join(numbered(gold, 0, skip).select("citation_id"), "citation_id", "left_semi")
        else:
            kept = previous
            gold = gold.join(previous.select("citation").distinct(), "citation", "left_anti")
    own = settled(numbered(gold, begin, None))
    if limit is not None:
        own = settled(own.orderBy("position").limit(limit))
    cited = own.select("citation_id", "citation")
    single = settled(engine.link_all(cited, apis))
    voted = engine.vote(cited, single, apis)
    rows = single.select(*RESULT, F.lit(None).cast("map<string,string>").alias("external_ids"))
    status = F.when(F.col("selected_doi").isNotNull(), "RESULT").otherwise("NO_RESULT")
    vote = voted.join(cited, "citation_id").select("citation_id", F.lit("ensemble").alias("api"), "citation", status.alias("status"), F.col("n_votes").cast("double").alias("score"), F.lit(None).cast("string").alias("pub_id"), F.col("selected_doi").alias("main_doi"), F.array().cast("array<string>").alias("alternative_dois"), F.lit(None).cast("string").alias("apa"), "external_ids")
    judged = evaluate(rows.unionByName(vote), own, loose)
    return judged if kept is None else judged.unionByName(kept, allowMissingColumns=True)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> Mapping[str, float]:
    """The command line; gives each approach's accuracy."""
    parser = argparse.ArgumentParser(description="Evaluate linking against a gold standard")
    parser.add_argument("--gold", required=True, help="JSON object from citation to expected identifiers")
    parser.add_argument("--publications", required=True, nargs="+", metavar="SOURCE=PATH", help="tables of publications (Parquet) by source")
    parser.add_argument("--output", default="evaluation_results")
    parser.add_argument("--skip", type=int, default=0, help="leave out the first citations")
    parser.add_argument("--limit", type=int, help="work on so many citations at most")
    parser.add_argument("--resume-from", help="results of an earlier run: its folder 05_results")
    parser.add_argument("--mode", choices=("strict", "loose"), default="strict")
    parser.add_argument("--preview", action="store_true", help="print the dashboard")
    parser.add_argument("--verbose", action="store_true", help="let Spark log warnings")
    asked = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("citation-evaluation").getOrCreate()
    spark.sparkContext.setLogLevel("WARN" if asked.verbose else "ERROR")
    tables = dict(p.partition("=")[::2] for p in asked.publications)
    engine = Engine({source(api).name: spark.read.parquet(path) for api, path in tables.items()})
    previous = read_results(spark, asked.resume_from) if asked.resume_from else None
    with scratch(spark):
        judged = settled(run_evaluation(engine, read_gold(spark, asked.gold), list(tables), asked.skip, asked.limit, previous, asked.mode == "loose"))
        apis = [a for a in (*SOURCES, "ensemble") if a in tables or a == "ensemble"]
        save_reports(judged, asked.output, apis, asked.mode)
        measured = metrics(judged, apis)
        if asked.preview:
            for r in dashboard(measured).orderBy("no").collect():
                print(r.line)
        return {r.api: r.accuracy for r in measured.collect()}


if __name__ == "__main__":
    main()
