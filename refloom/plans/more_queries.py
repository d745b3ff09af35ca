"""Registered queries of operators that the others don't reach, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions.doi import doi_match
from refloom.functions.entities import RAW_TYPE, best_entities
from refloom.operators.backends import RuleBackend
from refloom.operators.cache import evict
from refloom.operators.ensemble import elect, votes
from refloom.operators.evaluate import read_results
from refloom.operators.retrieve import BITS, expand_tiers, joined_names, wanted
from refloom.operators.spans import mentions_by_author_year, prescreen
from refloom.plans.evaluation import numbered
from refloom.plans.fixtures import cites, entity_struct
from refloom.plans.queries import _APIS, _VOTES_SQL, _results, query
from refloom.sources.spec import SOURCES, source
from refloom.sources.storage import new_place, settled, spread

_OTHERS = [s for s in SOURCES if s != "openalex"]


def _tier_values() -> str:
    """(api, tier, fields) of the tiers that a citation with all fields has, in SQL."""
    rows = []
    for api in _OTHERS:
        spec = source(api)
        for i, tier in enumerate(spec.tiers):
            own = [f for f in BITS if f in tier and f in spec.fields]
            if len(own) > 1 or set(own) & {"DOI", "TITLE", "TITLE_SEGMENTED"}:
                rows.append(f"('{api}', {i}, '{'+'.join(own)}')")
    return ", ".join(rows)


@query("tier_expand_others", f"""
SELECT api, citation_id, CAST(tier AS INT) AS tier, fields, tier = min(tier) OVER (PARTITION BY api, citation_id, fields) AND (fields <> 'DOI' OR regexp_matches(replace(raw_doi, 'https://doi.org/', ''), '^10[.][0-9]{{4,}}/[^ ]+$')) AS run, regexp_matches(fields, 'VOLUME|ISSUE|PAGE_FIRST') AS bibliographic
FROM cites CROSS JOIN (VALUES {_tier_values()}) t(api, tier, fields) WHERE fields <> 'DOI' OR raw_doi IS NOT NULL""")
def tiers_query(spark, sf_dir):
    """The tiers of the four sources that tier_expand leaves out."""
    c, out = spread(cites(spark, sf_dir).select("citation_id", entity_struct().alias("e"))), None
    for api in _OTHERS:
        t = settled(expand_tiers(c, source(api))).select(F.lit(api).alias("api"), "citation_id", F.explode("tiers").alias("t"))
        one = t.select("api", "citation_id", "t.tier", joined_names(F.col("t.mask")).alias("fields"), "t.run", "t.bibliographic")
        out = one if out is None else out.unionByName(one)
    return out


@query("wanted_candidates", """
SELECT citation_id, CASE WHEN citation_id % 2 = 0 THEN 10 WHEN citation_id % 3 = 0 THEN 30 WHEN raw_doi IS NULL THEN 20 ELSE 10 END AS wanted FROM cites""")
def wanted_query(spark, sf_dir):
    """How many candidates are looked for: every second citation has no title, every third of all has volume, issue and pages."""
    k, none = F.col("citation_id"), F.lit(None).cast("string")
    biblio = lambda c: F.when(k % 3 == 0, F.col(c)).otherwise(none)
    e = F.struct(F.col("raw_doi").alias("doi"), F.when(k % 2 == 0, F.col("raw_title")).alias("title"), biblio("volume").alias("volume"), biblio("issue").alias("issue"), biblio("first_page").alias("page_first"), biblio("raw_last").alias("page_last"))
    return cites(spark, sf_dir).select("citation_id", e.alias("e")).select("citation_id", wanted(F.col("e"), 10).alias("wanted"))


@query("citation_numbers", """
SELECT citation, printf('Cit_%03d', citation_id + 1) AS number, citation_id >= 7 AND citation_id < 507 AS in_part FROM cites""")
def numbers_query(spark, sf_dir):
    """Numbers of a gold standard in the order of citation_id, and which of them a run with skip 7 and limit 500 works on."""
    gold = cites(spark, sf_dir).select(F.col("citation_id").alias("position"), "citation")
    some = numbered(gold, 7, 500).select(F.col("citation_id").alias("n"), F.lit(True).alias("in_part"))
    whole = numbered(gold).select("citation", F.col("citation_id").alias("number"))
    return whole.join(some, F.col("number") == F.col("n"), "left").select("citation", "number", F.coalesce("in_part", F.lit(False)).alias("in_part"))


@query("doi_match", """
SELECT citation_id, api, CASE WHEN citation_id % 6 = 1 THEN 'N/A' WHEN main_doi IS NULL AND alt IS NULL THEN 'INCORRECT' WHEN main_doi = doi OR alt = concat(doi, '.v2') AND citation_id % 6 = 2 THEN 'EXACT' ELSE 'INCORRECT' END AS verdict
FROM (SELECT r.citation_id, r.api, c.doi, CASE WHEN (r.citation_id + r.o) % 5 = 0 THEN concat(c.doi, '.x') WHEN r.citation_id % 6 = 2 THEN concat(c.doi, '.y') ELSE c.doi END AS main_doi, CASE WHEN r.api = 'openaire' THEN concat(c.doi, '.v2') END AS alt
  FROM (SELECT citation_id, a.api, a.o FROM cites, (VALUES ('openalex', 1), ('openaire', 2), ('pubmed', 3), ('crossref', 4), ('hal', 5)) a(api, o)) r JOIN cites c ON r.citation_id = c.citation_id)""")
def doi_match_query(spark, sf_dir):
    """An expected DOI, with a resolver's address, against main DOIs and alternatives; every sixth citation expects the second DOI, every sixth none."""
    k = F.col("citation_id")
    rows = _results(spark, sf_dir)
    main = F.when((k + F.col("o")) % 5 == 0, F.concat("doi", F.lit(".x"))).when(k % 6 == 2, F.concat("doi", F.lit(".y"))).otherwise(F.col("doi"))
    others = F.when(F.col("api") == "openaire", F.array(F.concat("doi", F.lit(".v2")))).otherwise(F.array().cast("array<string>"))
    expected = F.when(k % 6 == 1, None).when(k % 6 == 2, F.concat(F.lit("https://doi.org/"), "doi", F.lit(".v2"))).otherwise(F.concat(F.lit("https://doi.org/"), "doi"))
    return rows.select("citation_id", "api", doi_match(main, others, expected).alias("verdict"))


@query("ensemble_breakdown", f"WITH {_VOTES_SQL} SELECT citation_id, string_agg(concat(doi, '=', n_votes), ';' ORDER BY k) AS breakdown FROM e GROUP BY citation_id")
def breakdown_query(spark, sf_dir):
    found = elect(votes(_results(spark, sf_dir).where("main_doi is not null"), _APIS))
    return found.select("citation_id", F.array_join(F.transform(F.map_entries("breakdown"), lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("breakdown"))


@query("cache_evict", "SELECT citation_id, title FROM (SELECT *, row_number() OVER (ORDER BY citation_id DESC) AS r, count(*) OVER () AS n FROM cites) WHERE n <= 1000 OR r <= 800")
def evict_query(spark, sf_dir):
    """A store of at most 1,000 results, cut to the newest 800."""
    return evict(cites(spark, sf_dir).select("citation_id", "title"), 1000, inserted="citation_id")


@query("previous_results", """
SELECT concat('Cit_', citation_id) AS citation_id, 'openalex' AS api, citation, CASE WHEN citation_id % 4 = 0 THEN 'NO_RESULT' ELSE 'RESULT' END AS status, CASE WHEN citation_id % 4 <> 0 THEN doi END AS main_doi, CASE WHEN citation_id % 4 <> 0 THEN concat(doi, '.v2') END AS other FROM cites""")
def previous_query(spark, sf_dir):
    """Results written as an earlier run saves them, and read again."""
    some = F.col("citation_id") % 4 != 0
    rows = cites(spark, sf_dir).select(F.concat(F.lit("Cit_"), "citation_id").alias("citation_id"), F.lit("openalex").alias("api"), "citation", F.when(some, "RESULT").otherwise("NO_RESULT").alias("status"), F.when(some, F.col("doi")).alias("main_doi"), F.when(some, F.array(F.concat("doi", F.lit(".v2")))).alias("alternative_dois"))
    place = new_place(spark, "earlier-results")
    rows.write.json(place)
    return read_results(spark, place).select("citation_id", "api", "citation", "status", "main_doi", F.get("alternative_dois", F.lit(0)).alias("other"))


@query("entity_clean_rest", """
SELECT citation_id, concat(surname, ', A., ', surname2, ', B.') AS authors, journal, issue,
  CASE WHEN citation_id % 2 = 0 AND left(first_page, 1) <> left(last_page, 1) THEN raw_last ELSE last_page END AS page_last FROM cites""")
def rest_query(spark, sf_dir):
    """The fields that entity_clean_select leaves out: the better of two values each, with spaces of a tokenizer in them. A last page of two digits takes the first page's beginning unless that would come before it."""
    raw = F.create_map(
        F.lit("AUTHORS"), F.array(F.concat(F.col("surname"), F.lit(" A")), F.concat("surname", F.lit(" , A. , "), "surname2", F.lit(" , B ."))),
        F.lit("JOURNAL"), F.array(F.lit("J"), F.concat(F.lit(", "), "journal", F.lit(" ;")), F.lit("Journal")),
        F.lit("ISSUE"), F.array(F.lit("no"), F.concat(F.lit("no . "), "issue")),
        F.lit("PAGE_FIRST"), F.array(F.col("first_page")),
        F.lit("PAGE_LAST"), F.array(F.lit("end"), F.col("raw_last")),
    ).cast(RAW_TYPE)
    found = cites(spark, sf_dir).withColumn("e", best_entities(raw))
    return found.select("citation_id", F.concat(F.regexp_replace("e.authors", r"\s+,", ","), F.lit(".")).alias("authors"), "e.journal", "e.issue", "e.page_last")


@query("mention_match_author_year", """
WITH m AS (SELECT citation_id // 10 AS doc_id, citation_id % 10 AS start, surname, raw_year, concat('case ', citation_id) AS sentence FROM cites),
r AS (SELECT citation_id // 10 AS doc_id, CAST(100 + citation_id % 10 AS INT) AS ref_start, surname, pub_year FROM cites)
SELECT r.doc_id, r.ref_start, string_agg(m.sentence, ';' ORDER BY m.start) AS claims FROM r JOIN m ON r.doc_id = m.doc_id AND r.surname = m.surname AND r.pub_year = m.raw_year GROUP BY 1, 2""")
def author_year_query(spark, sf_dir):
    k = F.col("citation_id")
    rows = cites(spark, sf_dir).withColumn("doc_id", F.floor(k / 10))
    mentions = rows.select("doc_id", (k % 10).cast("int").alias("start"), F.concat(F.lit("("), "surname", F.lit(" et al., "), "raw_year", F.lit(")")).alias("text"), F.concat(F.lit("case "), k).alias("masked_sentence"))
    refs = rows.select("doc_id", (k % 10 + 100).cast("int").alias("start"), F.lit(None).cast("string").alias("id"), F.struct(F.concat("surname", F.lit(" & "), "surname2").alias("authors"), F.col("pub_year").alias("publication_year")).alias("e"))
    return mentions_by_author_year(refs, mentions).select("doc_id", "ref_start", F.array_join("claims", ";").alias("claims"))


@query("prescreen_references", r"""
SELECT citation_id, length(text) >= 10 AND CAST(regexp_matches(text, '\b(19|20)\d{2}\b') AS INT) + CAST(regexp_matches(text, '10\.\d{4,}/\S+') AS INT) + CAST(regexp_matches(text, '\d+\s*\(\d+\)\s*\d+-\d+') AS INT) + CAST(text LIKE 'Surname_, A., %' AS INT) >= 2 AS valid
FROM (SELECT citation_id, CASE WHEN citation_id % 5 = 1 THEN left(citation, 8) ELSE citation END AS text FROM cites)""")
def prescreen_query(spark, sf_dir):
    """References that are long enough and look like citations; every fifth is cut to eight characters."""
    text = F.when(F.col("citation_id") % 5 == 1, F.substr("citation", F.lit(1), F.lit(8))).otherwise(F.col("citation"))
    return prescreen(cites(spark, sf_dir).select("citation_id", text.alias("text")), RuleBackend()).select("citation_id", "valid")
