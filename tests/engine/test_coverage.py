"""Registered queries work on all that their tables hold."""

import os

import pytest
from pyspark.sql import functions as F

from refloom.plans.fixtures import cites, document_text
from refloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_documents_list_what_is_no_citation_too(spark):
    listed = document_text(spark, SF).select(F.explode(F.split("text", "\n")).alias("line"))
    assert listed.where("line like '%was shipped on time'").count() == cites(spark, SF).where("citation_id % 17 = 3").count() > 0


def test_the_ensemble_asks_all_sources(spark):
    found = QUERIES["link_ensemble"](spark, SF).join(cites(spark, SF).select("citation_id", "work_id"), "citation_id")
    rows = found.where("work_id % 10 = 9 and citation_id % 17 != 3").select("selected_doi", "external_ids").collect()
    assert rows and sum(r.selected_doi is not None for r in rows) > 0.9 * len(rows)
    assert any("openalex=" in (r.external_ids or "") for r in rows) and any("pubmed=" in (r.external_ids or "") for r in rows)
