"""What keeps a query's work in proportion to its tables: plans without joins of all with all, and work done once a row."""

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refloom.operators.retrieve import expand_tiers
from refloom.operators.spans import DOCUMENTS, _merge, merged_spans
from refloom.plans.fixtures import cites
from refloom.plans.queries import QUERIES
from refloom.sources.payloads import publications
from refloom.sources.spec import source

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("column", ["citation", "raw_year", "raw_doi"])
def test_citations_meet_works_by_key(spark, column):
    """A filter on what is made of an order and a work, as a join or a distinct count adds it, leaves the join its key."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(cites(spark, SF).where(F.col(column).isNotNull()).select("citation_id", column))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "CartesianProduct" not in found and "NestedLoopJoin" not in found


def test_no_works_no_citations(spark, tmp_path):
    spark.sql("SELECT CAST(id AS BIGINT) AS o_orderkey FROM range(5)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT CAST(1 AS BIGINT) AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, 1 AS p_size").where("false").write.parquet(f"{tmp_path}/part.parquet")
    assert cites(spark, str(tmp_path)).count() == 0


def test_pubmed_texts_are_read_three_times(spark):
    """However many values are taken of an article, by one expression for all the single ones."""
    xml = "<S><PubmedArticle><MedlineCitation><PMID V='1'>7</PMID><Article><Journal><JournalIssue><Volume>3</Volume><PubDate><MedlineDate>1999 Jan</MedlineDate></PubDate></JournalIssue><ISOAbbreviation>J</ISOAbbreviation></Journal><ArticleTitle>A <i>b</i> &amp; c</ArticleTitle><Pagination><MedlinePgn>5-9</MedlinePgn></Pagination><ELocationID EIdType='pii'>x</ELocationID><ELocationID EIdType='doi'>10.1000/a</ELocationID><AuthorList><Author><LastName>Li</LastName><Initials>B</Initials></Author><Author><LastName>Wu</LastName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></S>"
    rows = publications(spark.createDataFrame([(1, xml), (2, "none"), (3, "<S></S>"), (4, None)], "k int, payload string"), "pubmed", keep=["k"])
    a, *rest = rows.orderBy("k").collect()
    assert (a.pub_id, a.title, a.authors, a.publication_year, a.journal, a.volume, a.issue) == ("7", "A b & c", ["Li, B.", "Wu"], "1999", "J", "3", None)
    assert (a.page_first, a.page_last, a.main_doi) == ("5", "9", "10.1000/a")
    assert all(r.pub_id is None and r.title is None and r.main_doi is None for r in rest) and rest[1].authors == []
    optimized = rows._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("Evaluator(") == 3


def test_tiers_look_once_at_what_a_citation_has(spark):
    """Not once for each tier: the optimizer puts a column that is named once into the function that names it."""
    e = "struct<doi: string, title: string, authors: string, journal: string, publication_year: string, volume: string, issue: string, page_first: string, page_last: string>"
    rows = expand_tiers(spark.createDataFrame([], f"citation_id int, e {e}"), source("pubmed"))
    assert not re.search(r"\.mask[^&,]*& \(*CASE", plan(rows))


@needs_data
def test_addresses_ask_for_their_own_fields_only(spark):
    assert "VOLUME" not in plan(QUERIES["request_urls"](spark, SF)) and "TITLE_SEGMENTED" not in plan(QUERIES["request_urls"](spark, SF))


@needs_data
def test_spans_are_made_where_their_document_is(spark):
    """Documents are dealt out, not their spans, of which there is one for every few characters."""
    lines = plan(QUERIES["span_group"](spark, SF)).splitlines()
    last, first = (next(i for i, x in enumerate(lines) if name in x) for name in ("functions=[collect_list", "functions=[partial_collect_list"))
    assert not any("Exchange" in x for x in lines[last:first])


def test_merged_spans_of_many_documents_are_columns():
    n = 3 * DOCUMENTS + 5
    texts = [None if k % 50 == 7 else f"ab {k} cd\nef" for k in range(n)]
    spans = [[(0, 2, "A", 1.0), (3, 4, "A", 0.5), (10, 12, "B", 1.0)][: k % 4] for k in range(n)]
    own = [pa.array([[s[i] for s in x] for x in spans], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.float64()))]
    (out,) = _merge.func(iter([(pa.array(texts, pa.string()), *own)]))
    assert out.to_pylist() == [merged_spans(t or "", x) for t, x in zip(texts, spans, strict=True)]
