"""Registered queries that fetch: catalogs of works, asked for page by page, from answers that are recorded first.

There is no network where they run: record() keeps what the sources would say, and fetch() sends every request through
batches, lanes and classes of status as it would to the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.plans.fixtures import works
from refloom.plans.queries import query
from refloom.sources.payloads import publications, response_rows
from refloom.sources.remote import dead_letters, delivered, fetch, record
from refloom.sources.spec import Pace, source
from refloom.sources.storage import new_place, settled

PAGE = 100
#: Recorded answers need no pause.
AT_ONCE = Pace(retries=3, base_delay=0.0, pause=0.0, timeout=10.0)
_PAYLOADS = {
    "openalex": "named_struct('id', concat('https://openalex.org/W', work_id), 'doi', concat('https://doi.org/', doi), 'title', title, 'publication_year', pub_year)",
    "openaire": "named_struct('id', concat('oa::', work_id), 'mainTitle', title, 'publicationDate', concat(pub_year, '-01-01'), 'pids', array(named_struct('scheme', 'doi', 'value', doi)))",
    "crossref": "named_struct('DOI', doi, 'title', array(title), 'issued', named_struct('date-parts', array(array(int(pub_year)))))",
    "hal": "named_struct('halId_s', concat('hal-', work_id), 'doiId_s', doi, 'title_s', array(title), 'publicationDateY_i', int(pub_year))",
}
_ANSWERS = {"openalex": "concat('{\"results\":', rows, '}')", "openaire": "concat('{\"results\":', rows, '}')", "crossref": "concat('{\"message\":{\"items\":', rows, '}}')", "hal": "concat('{\"response\":{\"docs\":', rows, '}}')"}


def _page_url(api: str) -> F.Column:
    return F.concat(F.lit(f"{source(api).base_url}?page="), F.col("page").cast("string"))


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of every source's catalog, and one page more than there are, as fetch() answers: api, url, status, attempts, body, error."""
    paged = settled(works(spark, sf_dir).withColumn("page", F.floor(F.col("work_id") / PAGE) + 1))
    place, asked = new_place(spark, "recorded"), None
    last = paged.agg(F.coalesce(F.max("page"), F.lit(0)).alias("page"))
    for api, payload in _PAYLOADS.items():
        # a page has PAGE works at most
        per = paged.groupBy("page").agg(F.to_json(F.array_sort(F.collect_list(F.struct("work_id", F.expr(payload).alias("p"))))["p"]).alias("rows"))
        record(per.select(_page_url(api).alias("url"), F.expr(_ANSWERS[api]).alias("body")), place)
        pages = paged.select("page").distinct().unionByName(last.select((F.col("page") + 1).alias("page")))
        one = pages.select(F.lit(api).alias("api"), _page_url(api).alias("url"))
        asked = one if asked is None else asked.unionByName(one)
    return fetch(asked, dict.fromkeys(_PAYLOADS, AT_ONCE), batch=50, replay=place)


@query("remote_fetch", " UNION ALL ".join(f"SELECT '{api}' AS api, {pub_id} AS pub_id, title, pub_year AS publication_year, doi AS main_doi FROM works" for api, pub_id in {"openalex": "concat('W', work_id)", "openaire": "concat('oa::', work_id)", "crossref": "doi", "hal": "concat('hal-', work_id)"}.items()))
def remote_fetch_query(spark, sf_dir):
    found, out = delivered(crawl(spark, sf_dir)), None
    for api in _PAYLOADS:
        rows = response_rows(found.where(F.col("api") == api), api, "body")
        one = publications(rows, api).select("api", "pub_id", "title", "publication_year", "main_doi")
        out = one if out is None else out.unionByName(one)
    return out


@query("remote_dead_letters", "SELECT api, concat(address, '?page=', CAST(p + 1 AS VARCHAR)) AS url, 404 AS status, 1 AS attempts, 'refused' AS outcome FROM (SELECT max(work_id // 100) + 1 AS p FROM works), (VALUES " + ", ".join(f"('{api}', '{source(api).base_url}')" for api in _PAYLOADS) + ") v(api, address)")
def dead_letters_query(spark, sf_dir):
    return dead_letters(crawl(spark, sf_dir)).select("api", "url", "status", "attempts", "outcome")
