"""The registered queries of the citation engine, with DuckDB SQL of those that SQL can express.

Each query runs over whole tables: citations and works projected from orders and part (see fixtures), line items as
scored candidates, and documents. The SQL is written on its own, from what an operator means.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.authors import author_words, surname, surname_query
from refloom.functions.doi import clean_doi, normalize_doi, normalize_id, publication_uri
from refloom.functions.entities import RAW_TYPE, best_entities
from refloom.functions.journal import names_score, normalize_journal
from refloom.functions.pages import citation_patterns, full_last_page, year_filter, year_range
from refloom.functions.similarity import doi_similarity, fuzzy, jaccard, number_similarity, page_similarity, with_similarity, year_similarity
from refloom.functions.text import clean_title, segment_title
from refloom.operators.backends import RuleBackend, rule_is_citation
from refloom.operators.cache import cache_key, hit_rate, not_yet_done
from refloom.operators.dedup import first_per_doi, greedy_unique
from refloom.operators.ensemble import admit, backfill, elect, votes
from refloom.operators.entities import group_entities, merge_fragments
from refloom.operators.evaluate import DISPLAY, calibration, comparison, compare_runs, evaluate, expected_error, final_evaluation, metrics, precision_recall
from refloom.operators.journals import resolve_journals
from refloom.operators.pairs import count_patterns, fit_pairs, with_pattern
from refloom.operators.rank import decide
from refloom.operators.retrieve import BITS, candidates, expand_tiers, joined_names, index_catalog, search
from refloom.operators.store import ResultStore
from refloom.operators.spans import attach_sentences, chunk_by_newline, citation_groups, group_adjacent, mask_mention, mentions_by_id, reference_list, split_sentences
from refloom.plans.engine import Engine
from refloom.plans.fixtures import CITES, WORKS, cites, document_text, entity_struct, publications, works
from refloom.sources.documents import chunk_documents
from refloom.sources.payloads import apa_citation, publications as parse_publications
from refloom.sources.requests import params_key, params_of, query_parts, request_url
from refloom.sources.spec import SOURCES, source
from refloom.sources.storage import new_place, settled, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_WITH = f"WITH works AS ({WORKS}), cites AS ({CITES})".replace("{part}", "part").replace("{orders}", "orders")


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL over the tables works and cites and the driver's."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            own = sql.lstrip()
            recursive = own.startswith("WITH RECURSIVE")
            before = _WITH.replace("WITH", "WITH RECURSIVE", 1) if recursive else _WITH
            ORACLE_SQL[name] = f"{before}, {own[14 if recursive else 4 :].lstrip()}" if own.startswith("WITH") else f"{before} {own}"
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# scalar functions


@query("clean_doi", r"""
SELECT citation_id, CASE WHEN regexp_matches(d, '^10\.\d{4,}/[^\s]+$') THEN d END AS doi
FROM (SELECT citation_id, trim(replace(replace(raw_doi, 'https://doi.org/', ''), 'http://dx.doi.org/', '')) AS d FROM cites)""")
def clean_doi_query(spark, sf_dir):
    return cites(spark, sf_dir).select("citation_id", clean_doi(F.col("raw_doi")).alias("doi"))


@query("normalize_doi", r"""
SELECT citation_id, nullif(lower(rtrim(regexp_replace(trim(raw_doi), '^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|http://dx\.doi\.org/|doi:)', '', 'i'), '/')), '') AS doi FROM cites""")
def normalize_doi_query(spark, sf_dir):
    return cites(spark, sf_dir).select("citation_id", normalize_doi(F.col("raw_doi")).alias("doi"))


@query("normalize_api_id", """
SELECT citation_id, CASE citation_id % 5 WHEN 0 THEN concat('W', work_id) WHEN 1 THEN concat('oa::', work_id) WHEN 2 THEN CAST(work_id AS VARCHAR) WHEN 3 THEN lower(doi) ELSE concat('hal-', work_id) END AS id FROM cites""")
def normalize_id_query(spark, sf_dir):
    k, w = F.col("citation_id") % 5, F.col("work_id")
    api = F.element_at(F.array(*map(F.lit, ("openalex", "openaire", "pubmed", "crossref", "hal"))), (k + 1).cast("int"))
    raw = F.when(k == 0, F.concat(F.lit("https://openalex.org/W"), w)).when(k == 1, F.concat(F.lit("oa::"), w)).when(k == 2, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), w)).when(k == 3, F.concat(F.lit("https://doi.org/"), "doi")).otherwise(F.concat(F.lit("https://hal.science/hal-"), w))
    return cites(spark, sf_dir).select("citation_id", normalize_id(api, raw).alias("id"))


@query("publication_uri", """
SELECT citation_id, CASE citation_id % 3 WHEN 0 THEN concat('https://openalex.org/W', work_id) WHEN 1 THEN concat('https://doi.org/', doi) ELSE concat('https://hal.science/W', work_id) END AS uri FROM cites""")
def uri_query(spark, sf_dir):
    api = F.element_at(F.array(*map(F.lit, ("openalex", "crossref", "hal"))), (F.col("citation_id") % 3 + 1).cast("int"))
    return cites(spark, sf_dir).select("citation_id", publication_uri(api, F.concat(F.lit("W"), "work_id"), F.col("doi")).alias("uri"))


_TITLE = r"""regexp_replace(trim(regexp_replace(regexp_replace(raw_title, '[''"]+', '', 'g'), '\s+', ' ', 'g')), '[.,;:\-\s]+$', '')"""


@query("clean_title", f"SELECT citation_id, {_TITLE} AS title FROM cites")
def clean_title_query(spark, sf_dir):
    return cites(spark, sf_dir).select("citation_id", clean_title(F.col("raw_title")).alias("title"))


@query("segment_title", f"""
SELECT citation_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE concat(array_to_string(w[1:len(w) // 2], ' '), '|', array_to_string(w[len(w) // 2 + 1:], ' ')) END AS query
FROM (SELECT citation_id, string_split({_TITLE}, ' ') AS w FROM cites)""")
def segment_title_query(spark, sf_dir):
    return cites(spark, sf_dir).select("citation_id", segment_title(F.col("raw_title")).alias("query"))


@query("author_surname", "SELECT citation_id, CASE citation_id % 6 WHEN 4 THEN 'Anna' ELSE surname END AS surname FROM cites")
def surname_query_(spark, sf_dir):
    return cites(spark, sf_dir).select("citation_id", surname(F.col("raw_authors")).alias("surname"))


@query("author_surname_boolean", """
SELECT citation_id, CASE citation_id % 6 WHEN 4 THEN 'Anna' WHEN 2 THEN concat('((', surname, ' AND ', surname2, ') OR ', surname, ' OR ', surname2, ')') ELSE surname END AS query FROM cites""")
def surname_boolean_query(spark, sf_dir):
    return cites(spark, sf_dir).select("citation_id", surname_query(F.col("raw_authors")).alias("query"))


@query("year_filters", """
SELECT citation_id, concat(raw_year, '-01-01') AS from_date, concat(raw_year, '-12-31') AS to_date, concat('from-pub-date:', raw_year, '-01-01,until-pub-date:', raw_year, '-12-31') AS filter FROM cites""")
def year_filters_query(spark, sf_dir):
    days = year_range(F.col("raw_year"))
    return cites(spark, sf_dir).select("citation_id", days["from_date"].alias("from_date"), days["to_date"].alias("to_date"), year_filter(F.col("raw_year")).alias("filter"))


@query("pattern_extract", r"""
SELECT citation_id, nullif(regexp_extract(citation, '(\d+)\s*\((\d+)\)\s*(\d+)-(\d+)', 1), '') AS volume, nullif(regexp_extract(citation, '(\d+)\s*\((\d+)\)\s*(\d+)-(\d+)', 2), '') AS issue,
       nullif(regexp_extract(citation, '(\d+)\s*\((\d+)\)\s*(\d+)-(\d+)', 3), '') AS page_first, nullif(regexp_extract(citation, '(\d+)\s*\((\d+)\)\s*(\d+)-(\d+)', 4), '') AS page_last,
       nullif(regexp_extract(citation, '\((\d{4})\)', 1), '') AS publication_year, nullif(regexp_extract(citation, 'DOI:\s*(10\.\d+/[^\s]+)', 1), '') AS doi FROM cites""")
def pattern_query(spark, sf_dir):
    return cites(spark, sf_dir).withColumn("x", citation_patterns(F.col("citation"))).select("citation_id", "x.*")


@query("page_range_reconstruct", """
SELECT citation_id, CASE WHEN length(raw_last) < length(first_page) AND CAST(raw_last AS BIGINT) <= CAST(first_page AS BIGINT)
       AND CAST(concat(left(first_page, length(first_page) - length(raw_last)), raw_last) AS BIGINT) > CAST(first_page AS BIGINT)
       THEN concat(left(first_page, length(first_page) - length(raw_last)), raw_last) ELSE raw_last END AS page_last FROM cites""")
def page_range_query(spark, sf_dir):
    return cites(spark, sf_dir).select("citation_id", full_last_page(F.col("first_page"), F.col("raw_last")).alias("page_last"))


@query("entity_clean_select", """
SELECT citation_id, CASE WHEN raw_doi IS NULL THEN NULL WHEN citation_id % 4 <> 1 AND citation_id % 11 = 2 THEN concat(upper(doi), '/') ELSE doi END AS doi, title, pub_year AS publication_year, volume, first_page AS page_first FROM cites""")
def entities_query(spark, sf_dir):
    none = F.lit(None).cast("string")
    raw = F.create_map(
        F.lit("DOI"), F.array_compact(F.array(F.lit("##12"), F.col("raw_doi"))),
        F.lit("TITLE"), F.array(F.lit("short"), F.concat(F.lit("- "), "title", F.lit(" ."))),
        F.lit("PUBLICATION_YEAR"), F.array(F.lit("n.d."), F.concat(F.lit("c"), "pub_year"))
        , F.lit("VOLUME"), F.array(F.lit("vol"), F.concat(F.lit("vol "), "volume")),
        F.lit("PAGE_FIRST"), F.array_compact(F.array(none, F.concat(F.lit("p "), "first_page"))),
    ).cast(RAW_TYPE)
    e = best_entities(raw)
    return cites(spark, sf_dir).withColumn("e", e).select("citation_id", "e.doi", "e.title", "e.publication_year", "e.volume", "e.page_first")


@query("journal_normalize", "SELECT work_id, replace(replace(lower(journal), ' of ', ' '), '.', ' ') AS journal FROM works")
def journal_query(spark, sf_dir):
    return works(spark, sf_dir).select("work_id", normalize_journal(F.col("journal")).alias("journal"))


@query("prescreen_classify", r"""
SELECT citation_id, n >= 2 AS is_citation, CASE WHEN n >= 2 THEN 0.5 + n / 8 ELSE 1 - n / 4 END AS score FROM (SELECT citation_id,
  CAST(CAST(regexp_matches(citation, '\b(19|20)\d{2}\b') AS INT) + CAST(regexp_matches(citation, '10\.\d{4,}/\S+') AS INT) + CAST(regexp_matches(citation, '\d+\s*\(\d+\)\s*\d+-\d+') AS INT) + CAST(citation LIKE 'Surname_, A., %' AS INT) AS DOUBLE) AS n FROM cites)""")
def classify_query(spark, sf_dir):
    return cites(spark, sf_dir).withColumn("x", rule_is_citation(F.col("citation"))).select("citation_id", F.col("x.label").alias("is_citation"), F.col("x.score").cast("double").alias("score"))


# similarities


@query("year_similarity", """
SELECT citation_id, CASE WHEN citation_id % 7 = 0 THEN 0.7 ELSE 1.0 END::DOUBLE AS score FROM cites""")
def year_similarity_query(spark, sf_dir):
    return cites(spark, sf_dir).select("citation_id", year_similarity(F.col("raw_year"), F.col("pub_year")).alias("score"))


@query("field_equality", """
SELECT citation_id, CASE WHEN raw_doi IS NOT NULL AND (citation_id % 4 = 1 OR citation_id % 11 <> 2) THEN 1.0 ELSE 0.0 END::DOUBLE AS doi_score, 1.0::DOUBLE AS volume_score, CASE WHEN raw_last = last_page THEN 1.0 ELSE 0.0 END::DOUBLE AS page_score FROM cites""")
def equality_query(spark, sf_dir):
    return cites(spark, sf_dir).select("citation_id", doi_similarity(F.col("raw_doi"), F.col("doi")).alias("doi_score"), number_similarity(F.concat(F.lit("vol. "), "volume"), F.col("volume")).alias("volume_score"), page_similarity(F.col("raw_last"), F.col("last_page")).alias("page_score"))


@query("author_jaccard", """
SELECT citation_id, CASE citation_id % 6 WHEN 2 THEN 1.0 WHEN 4 THEN 1.0 / 3 WHEN 5 THEN 1.0 / 5 ELSE 0.5 END::DOUBLE AS score FROM cites""")
def jaccard_query(spark, sf_dir):
    return cites(spark, sf_dir).select("citation_id", jaccard(author_words(F.col("raw_authors")), author_words(F.concat_ws(" ", "surname", "surname2"))).alias("score"))


@query("title_ratio")
def ratio_query(spark, sf_dir):
    return cites(spark, sf_dir).select("citation_id", fuzzy(F.col("raw_title"), F.concat(F.lit("A "), "title")).alias("score"))


@query("journal_alignment")
def alignment_query(spark, sf_dir):
    w = works(spark, sf_dir).select("work_id", normalize_journal(F.col("journal")).alias("a"), normalize_journal(F.regexp_replace("journal", "^Journal of (.{3})\\w* systems", "J. $1. Syst.")).alias("b"))
    return w.select("work_id", names_score(F.col("a"), F.col("b")).alias("score"))


@query("ner_similarity")
def similarity_query(spark, sf_dir):
    c = cites(spark, sf_dir).withColumn("a", entity_struct())
    b = F.struct("doi", "title", F.concat_ws(", ", "surname", "surname2").alias("authors"), "journal", F.col("pub_year").alias("publication_year"), "volume", "issue", F.col("first_page").alias("page_first"), F.col("last_page").alias("page_last"))
    return with_similarity(c.withColumn("b", b), "a", "b", "citation", "title", "score").select("citation_id", "score")


# entities and spans, from line items and documents

_HITS = """SELECT l_orderkey AS citation_id, l_linenumber AS n, CASE WHEN l_partkey % 3 < 2 THEN 'TITLE' ELSE 'JOURNAL' END AS label, concat('w', CAST(l_linenumber AS VARCHAR(20))) AS word,
  l_linenumber * 10 AS start, l_linenumber * 10 + 8 + l_suppkey % 3 AS "end", CAST(l_quantity AS DOUBLE) AS score
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM {lineitem} GROUP BY 1, 2)"""


def _hits(spark, sf_dir) -> DataFrame:
    return spark.sql(_HITS.replace('"end"', "`end`"), lineitem=_read(spark, sf_dir, "lineitem"))


_HITS_SQL = _HITS.replace("{lineitem}", "lineitem")


@query("ner_fragment_merge", f"""WITH h AS ({_HITS_SQL}),
f AS (SELECT *, CASE WHEN lag(label) OVER o = label AND start <= lag("end") OVER o + 1 THEN 0 ELSE 1 END AS fresh FROM h WINDOW o AS (PARTITION BY citation_id ORDER BY start, "end")),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY citation_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT citation_id, label, string_agg(word, '' ORDER BY start) AS word, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end", max(score) AS score FROM i GROUP BY citation_id, island, label""")
def merge_query(spark, sf_dir):
    return merge_fragments(_hits(spark, sf_dir)).select("citation_id", "label", "word", F.col("start").cast("long"), F.col("end").cast("long"), "score")


@query("entity_group", f"""WITH h AS ({_HITS_SQL})
SELECT citation_id, max(CASE WHEN label = 'TITLE' THEN words END) AS titles, max(CASE WHEN label = 'JOURNAL' THEN words END) AS journals
FROM (SELECT citation_id, label, string_agg(word, ',' ORDER BY start) AS words FROM h GROUP BY 1, 2) GROUP BY citation_id""")
def group_query(spark, sf_dir):
    e = group_entities(_hits(spark, sf_dir))
    of = lambda k: F.array_join(F.try_element_at("entities", F.lit(k)), ",")
    return e.select("citation_id", of("TITLE").alias("titles"), of("JOURNAL").alias("journals"))


_SPANS = """SELECT doc_id, CASE WHEN (doc_id + k) % 4 = 0 THEN 'CITATION_ID' WHEN (doc_id + k) % 4 = 1 THEN 'CITATION_SPAN' WHEN (doc_id + k // 2) % 2 = 0 THEN 'YEAR' ELSE 'AUTHOR' END AS label,
  CAST(k * 12 AS INT) AS start, CAST(k * 12 + 10 + (doc_id + k) % 3 AS INT) AS "end", 1.0::DOUBLE AS score FROM (SELECT doc_id, unnest(range(0, length(text) // 12)) AS k FROM documents)"""


def _documents(spark, sf_dir) -> DataFrame:
    """Documents dealt out by doc_id, so that what is made of one meets its text without another shuffle."""
    return _read(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")


def _spans(docs: DataFrame) -> DataFrame:
    k, d = F.col("k"), F.col("doc_id")
    label = F.when((d + k) % 4 == 0, "CITATION_ID").when((d + k) % 4 == 1, "CITATION_SPAN").when((d + F.floor(k / 2)) % 2 == 0, "YEAR").otherwise("AUTHOR")
    rows = docs.where("length(text) >= 12").select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("length(text) div 12 - 1").cast("int"))).alias("k"))
    return rows.select("doc_id", label.alias("label"), (k * 12).cast("int").alias("start"), (k * 12 + 10 + (d + k) % 3).cast("int").alias("end"), F.lit(1.0).alias("score"))


_GROUPED = f"""s AS (SELECT s.*, d.text FROM ({_SPANS}) s JOIN documents d USING (doc_id)),
f AS (SELECT *, CASE WHEN lag(label) OVER o = label AND (start <= lag("end") OVER o + 1 OR trim(substr(text, lag("end") OVER o + 1, start - lag("end") OVER o), E' \\n\\t\\r') = '')
  AND NOT contains(substr(text, lag("end") OVER o + 1, start - lag("end") OVER o), E'\\n') THEN 0 ELSE 1 END AS fresh FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY start)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM f),
g AS (SELECT doc_id, any_value(label) AS label, min(start) AS start, max("end") AS "end", any_value(text) AS text FROM i GROUP BY doc_id, island)"""


@query("span_group", f"""WITH {_GROUPED} SELECT doc_id, label, start, "end", substr(text, start + 1, "end" - start) AS word FROM g""")
def span_group_query(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return group_adjacent(_spans(docs), docs).drop("score")


@query("citation_group_sessionize", f"""WITH {_GROUPED},
m AS (SELECT *, label <> 'CITATION_SPAN' AS inside FROM g),
n AS (SELECT *, CASE WHEN inside AND lag(inside) OVER o AND start - lag("end") OVER o <= 3 THEN 0 ELSE 1 END AS fresh FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY start)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT doc_id, min(start) AS start, max("end") AS "end", count(*) AS n_entities FROM r WHERE inside GROUP BY doc_id, run""")
def sessionize_query(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return citation_groups(group_adjacent(_spans(docs), docs)).select("doc_id", "start", "end", F.size("entities").cast("long").alias("n_entities"))


@query("reference_id_attach", f"""WITH {_GROUPED},
r AS (SELECT *, CASE WHEN lag(label) OVER o = 'CITATION_ID' AND start - lag("end") OVER o <= 2 THEN lag(substr(text, start + 1, "end" - start)) OVER o END AS before FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY start))
SELECT doc_id, trim(translate(before, '[]()', ''), E' \\n\\t\\r') AS id, trim(replace(substr(text, start + 1, "end" - start), E'\\n', ' '), ' ') AS text, start, "end" FROM r WHERE label = 'CITATION_SPAN'""")
def reference_query(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return reference_list(group_adjacent(_spans(docs), docs))


@query("chunk_by_newline", r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cursor, CAST(0 AS BIGINT) AS begin, '' AS now, CAST(NULL AS BIGINT) AS o, CAST(NULL AS VARCHAR) AS chunk FROM documents
  UNION ALL SELECT doc_id, i, cursor + size, CASE WHEN cut THEN cursor ELSE begin END, CASE WHEN cut THEN '' ELSE now END || line || chr(10), CASE WHEN cut THEN begin END, CASE WHEN cut THEN rtrim(now, chr(10)) END
  FROM (SELECT f.doc_id, l.i, f.cursor, f.begin, f.now, l.line, length(l.line) + 1 AS size, length(f.now) + length(l.line) + 1 > 2000 AND regexp_matches(f.now, '[^\s\p{Z}\x{85}]') AS cut FROM f JOIN l ON f.doc_id = l.doc_id AND l.i = f.i + 1)),
c AS (SELECT doc_id, i, o, chunk FROM f WHERE chunk IS NOT NULL UNION ALL SELECT doc_id, i + 1, begin, rtrim(now, chr(10)) FROM f WHERE regexp_matches(now, '[^\s\p{Z}\x{85}]') QUALIFY i = max(i) OVER (PARTITION BY doc_id))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_no, CAST(o AS INT) AS "offset", chunk FROM c""")
def chunk_query(spark, sf_dir):
    return chunk_by_newline(_read(spark, sf_dir, "documents"))


ORACLE_SQL["document_chunks"] = ORACLE_SQL["chunk_by_newline"]


@query("document_chunks")
def document_chunks_query(spark, sf_dir):
    """The same chunks by the table function over documents' bytes."""
    files = _read(spark, sf_dir, "documents").select("doc_id", F.lit("x.txt").alias("path"), F.col("text").cast("binary").alias("content"))
    return chunk_documents(files).select("doc_id", "chunk_no", "offset", "chunk")


@query("split_sentences")
def sentences_query(spark, sf_dir):
    return split_sentences(_read(spark, sf_dir, "documents"))


_LINES = """SELECT doc_id, CAST(k * 50 AS INT) AS start, CAST(k * 50 + 50 AS INT) AS "end", substr(text, k * 50 + 1, 50) AS sentence FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 49) // 50)) AS k FROM documents)"""


@query("sentence_attach_mask", f"""WITH {_GROUPED}, l AS ({_LINES})
SELECT g.doc_id, g.start, g."end", l.sentence, replace(substr(l.sentence, 1, g.start - l.start) || '[REF]' || substr(l.sentence, g."end" - l.start + 1), E'\\n', ' ') AS masked_sentence
FROM g LEFT JOIN l ON g.doc_id = l.doc_id AND g.start >= l.start AND g."end" <= l."end" """)
def attach_query(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    rows = docs.where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.expr("(length(text) - 1) div 50").cast("int"))).alias("k"))
    sentences = rows.select("doc_id", (F.col("k") * 50).alias("start"), (F.col("k") * 50 + 50).alias("end"), F.substr("text", (F.col("k") * 50 + 1), F.lit(50)).alias("sentence"))
    groups = group_adjacent(_spans(docs), docs).select("doc_id", "start", "end")
    return mask_mention(attach_sentences(groups, sentences)).select("doc_id", "start", "end", "sentence", "masked_sentence")


_MENTIONS = "SELECT citation_id // 10 AS doc_id, CAST(citation_id % 10 AS INT) AS start, concat('[', citation_id % 3, ']') AS word, concat('case ', citation_id) AS masked_sentence FROM cites"


@query("mention_match_id", f"""WITH m AS ({_MENTIONS}),
r AS (SELECT DISTINCT doc_id, CAST(100 + substr(word, 2, 1)::INT AS INT) AS ref_start, word AS id FROM m),
j AS (SELECT r.doc_id, r.ref_start, m.start, m.masked_sentence, row_number() OVER (PARTITION BY r.doc_id, r.ref_start ORDER BY m.start DESC) AS k FROM r JOIN m ON r.doc_id = m.doc_id AND r.id = m.word)
SELECT doc_id, ref_start, coalesce(string_agg(CASE WHEN k > 1 THEN masked_sentence END, ';' ORDER BY start), '') AS claims FROM j GROUP BY 1, 2""")
def mention_query(spark, sf_dir):
    k = F.col("citation_id")
    word = F.concat(F.lit("["), k % 3, F.lit("]"))
    m = cites(spark, sf_dir).select(F.floor(k / 10).alias("doc_id"), (k % 10).cast("int").alias("start"), F.array(F.struct(F.lit("CITATION_ID").alias("label"), word.alias("word"))).alias("entities"), F.concat(F.lit("case "), k).alias("masked_sentence"))
    refs = m.select("doc_id", (F.substr(F.col("entities")[0]["word"], F.lit(2), F.lit(1)).cast("int") + 100).alias("start"), F.col("entities")[0]["word"].alias("id")).distinct()
    return mentions_by_id(refs, m).select("doc_id", "ref_start", F.array_join("claims", ";").alias("claims"))


# retrieval


# a search's tiers: every citation has all fields but a DOI now and then, which some write in a way that can't be asked for
_TIER_ROWS = ", ".join(f"({i}, '{'+'.join(f for f in BITS if f in tier)}')" for i, tier in enumerate(source("openalex").tiers))


@query("tier_expand", f"""
SELECT citation_id, CAST(tier AS INT) AS tier, fields, tier = min(tier) OVER (PARTITION BY citation_id, fields) AND (tier > 0 OR regexp_matches(replace(raw_doi, 'https://doi.org/', ''), '^10[.][0-9]{{4,}}/[^ ]+$')) AS run, regexp_matches(fields, 'VOLUME|ISSUE|PAGE_FIRST') AS bibliographic
FROM cites CROSS JOIN (VALUES {_TIER_ROWS}) t(tier, fields) WHERE tier > 0 OR raw_doi IS NOT NULL""")
def tiers_query(spark, sf_dir):
    c = spread(cites(spark, sf_dir).select("citation_id", entity_struct().alias("e")))
    t = settled(expand_tiers(c, source("openalex"))).select("citation_id", F.explode("tiers").alias("t"))
    return t.select("citation_id", "t.tier", joined_names(F.col("t.mask")).alias("fields"), "t.run", "t.bibliographic")


@query("query_params", """
SELECT citation_id, concat(CASE WHEN citation_id % 6 = 4 THEN '' ELSE '' END, 'filter=from-pub-date:', raw_year, '-01-01,until-pub-date:', raw_year, '-12-31',
  CASE WHEN raw_doi IS NOT NULL AND (citation_id % 4 = 1 OR citation_id % 11 <> 2) THEN concat('&query=', doi) ELSE '' END,
  '&query.author=', CASE citation_id % 6 WHEN 4 THEN 'Anna' ELSE surname END, '&query.container-title=', journal, '&query.title=', raw_title) AS params FROM cites""")
def params_query(spark, sf_dir):
    spec = source("crossref")
    c = cites(spark, sf_dir).withColumn("e", entity_struct()).withColumn("parts", query_parts(spec, F.col("e")))
    return c.select("citation_id", params_key(params_of(F.col("parts"), F.array(*map(F.lit, spec.fields)))).alias("params"))


_FORM = "replace(url_encode({}), '%20', '+')"
_URLS = {
    "openalex": """concat('https://api.openalex.org/works?per-page=5&filter=title.search:"', url_encode(clean), '",raw_author_name.search:', url_encode(names), ',publication_year:', raw_year)""",
    "openaire": f"concat('https://api.openaire.eu/graph/v1/researchProducts?mainTitle=', {_FORM.format('raw_title')}, '&authorFullName=', {_FORM.format('names')}, '&fromPublicationDate=', raw_year, '-01-01&toPublicationDate=', raw_year, '-12-31&pageSize=5')",
    "pubmed": f"concat('https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=pubmed&retmode=json&retmax=5&term=', {_FORM.format("concat(raw_title, '[title] AND ', name, '[author] AND ', raw_year, '[pdat]')")})",
    "crossref": f"concat('https://api.crossref.org/works?query.title=', {_FORM.format('raw_title')}, '&query.author=', {_FORM.format('name')}, '&filter=', {_FORM.format("concat('from-pub-date:', raw_year, '-01-01,until-pub-date:', raw_year, '-12-31')")}, '&rows=5')",
    "hal": f"""concat('https://api.archives-ouvertes.fr/search/?q=', {_FORM.format("""concat('title_t:"', raw_title, '" AND authFullName_t:"', name, '" AND publicationDateY_s:"', raw_year, '"')""")}, '&fl=*&wt=json&rows=5')""",
}


@query("request_urls", f"""WITH q AS (SELECT *, {_TITLE} AS clean, CASE citation_id % 6 WHEN 4 THEN 'Anna' ELSE surname END AS name,
  CASE citation_id % 6 WHEN 4 THEN 'Anna' WHEN 2 THEN concat('((', surname, ' AND ', surname2, ') OR ', surname, ' OR ', surname2, ')') ELSE surname END AS names FROM cites)
""" + " UNION ALL ".join(f"SELECT citation_id, '{a}' AS api, {u} AS url FROM q" for a, u in _URLS.items()))
def urls_query(spark, sf_dir):
    c = spread(cites(spark, sf_dir).select("citation_id", entity_struct().alias("e")))
    asked, out = ("TITLE", "AUTHORS", "PUBLICATION_YEAR"), None
    for api in SOURCES:
        # parts of the fields that are asked for, and no others
        spec = replace(source(api), fields={f: how for f, how in source(api).fields.items() if f in asked})
        one = c.withColumn("parts", query_parts(spec, F.col("e"))).select("citation_id", F.lit(api).alias("api"), request_url(api, params_of(F.col("parts"), F.array(*map(F.lit, asked))), F.lit(5)).alias("url"))
        out = one if out is None else out.unionByName(one)
    return out


@query("retrieve_doi", """
SELECT c.citation_id, concat('W', w.work_id) AS pub_id FROM cites c JOIN works w ON c.doi = w.doi WHERE c.raw_doi IS NOT NULL AND (c.citation_id % 4 = 1 OR c.citation_id % 11 <> 2)""")
def retrieve_doi_query(spark, sf_dir):
    c = cites(spark, sf_dir).select("citation_id", F.struct(F.col("raw_doi").alias("doi"), *(F.lit(None).cast("string").alias(n) for n in ("title", "authors", "journal", "publication_year", "volume", "issue", "page_first", "page_last"))).alias("e"))
    return search(c, index_catalog(publications(spark, sf_dir, "openalex")), source("openalex")).select("citation_id", "pub_id")


_TIER_MASKS = ", ".join(f"({i}, {sum(BITS[f] for f in tier)})" for i, tier in enumerate(source("openalex").tiers))
# publications by pairs of flags, tiers by masks of flags, then the sequential stop as sums over tiers
_RETRIEVED = f"""p AS (SELECT concat('W', work_id) AS pub_id, doi, list_distinct(string_split(lower(title), ' ')) AS tokens, lower(surname) AS n1, lower(surname2) AS n2, pub_year, journal, volume, issue, first_page FROM works),
q AS (SELECT citation_id, CASE WHEN regexp_matches(replace(raw_doi, 'https://doi.org/', ''), '^10[.][0-9]{{4,}}/[^ ]+$') THEN doi END AS doi, title, string_split(lower(title), ' ') AS w, raw_year, journal, volume, issue, first_page,
  CASE citation_id % 6 WHEN 4 THEN ['anna'] WHEN 2 THEN [lower(surname), lower(surname2)] ELSE [lower(surname)] END AS names FROM cites),
t AS (SELECT DISTINCT title, list_distinct(w) AS tokens, list_distinct(w[1:len(w) // 2]) AS h1, list_distinct(w[len(w) // 2 + 1:]) AS h2 FROM q),
tm AS (SELECT title, pub_id, list_has_all(p.tokens, t.tokens) AS is_t FROM t JOIN p ON list_has_all(p.tokens, t.h1) OR list_has_all(p.tokens, t.h2)),
qn AS (SELECT citation_id, unnest(names) AS n, raw_year, journal FROM q), pn AS (SELECT pub_id, unnest([n1, n2]) AS n, pub_year, journal FROM p),
pairs AS (SELECT citation_id, pub_id FROM q JOIN p ON q.doi = p.doi UNION SELECT citation_id, pub_id FROM q JOIN tm ON q.title = tm.title UNION SELECT citation_id, pub_id FROM q JOIN p ON q.journal = p.journal AND q.raw_year = p.pub_year
  UNION SELECT citation_id, pub_id FROM qn JOIN pn ON qn.n = pn.n AND qn.raw_year = pn.pub_year UNION SELECT citation_id, pub_id FROM qn JOIN pn ON qn.n = pn.n AND qn.journal = pn.journal),
fits AS (SELECT x.citation_id, x.pub_id, len(list_intersect(t.tokens, p.tokens)) / len(list_distinct(list_concat(t.tokens, p.tokens))) AS share,
  CASE WHEN q.doi = p.doi THEN 1 ELSE 0 END + CASE WHEN tm.is_t THEN 2 ELSE 0 END + CASE WHEN tm.pub_id IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN list_has_any(q.names, [p.n1, p.n2]) THEN 8 ELSE 0 END + CASE WHEN q.raw_year = p.pub_year THEN 16 ELSE 0 END
  + CASE WHEN q.journal = p.journal THEN 32 ELSE 0 END + CASE WHEN q.volume = p.volume THEN 64 ELSE 0 END + CASE WHEN q.issue = p.issue THEN 128 ELSE 0 END + CASE WHEN q.first_page = p.first_page THEN 256 ELSE 0 END AS bits
  FROM pairs x JOIN q USING (citation_id) JOIN t USING (title) JOIN p USING (pub_id) LEFT JOIN tm ON tm.title = q.title AND tm.pub_id = x.pub_id),
hits AS (SELECT citation_id, tier, mask, pub_id, row_number() OVER (PARTITION BY citation_id, tier ORDER BY share DESC, pub_id) AS rank FROM fits JOIN (VALUES {_TIER_MASKS}) m(tier, mask) ON (bits & mask) = mask),
cut AS (SELECT * FROM hits WHERE rank <= CASE WHEN bit_count(mask) <= 2 AND (mask & 3) = 0 THEN 10 ELSE 5 END),
n AS (SELECT citation_id, tier, mask, count(*) AS n FROM cut GROUP BY ALL),
ran AS (SELECT citation_id, tier FROM n WINDOW w AS (PARTITION BY citation_id ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY coalesce(sum(n) OVER w, 0) < 10 AND coalesce(sum(CASE WHEN n = 1 AND bit_count(mask) >= 4 AND (mask & 451) <> 0 THEN 1 ELSE 0 END) OVER w, 0) = 0),
firsts AS (SELECT citation_id, pub_id, tier, rank FROM cut JOIN ran USING (citation_id, tier) QUALIFY row_number() OVER (PARTITION BY citation_id, pub_id ORDER BY tier, rank) = 1)"""


@query("retrieve_progressive", f"""WITH {_RETRIEVED}
SELECT citation_id, CAST(pos - 1 AS INT) AS pos, CAST(tier AS INT) AS tier, pub_id FROM (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY tier, rank) AS pos FROM firsts) WHERE pos <= 10""")
def candidates_query(spark, sf_dir):
    c = cites(spark, sf_dir).select("citation_id", entity_struct().alias("e"))
    return candidates(c, publications(spark, sf_dir, "openalex"), source("openalex"))


@query("dedup_single_doi", """
SELECT citation_id, pos, main_doi FROM (SELECT *, row_number() OVER (PARTITION BY citation_id, main_doi ORDER BY pos) AS n FROM (SELECT l_orderkey AS citation_id, l_linenumber AS pos, concat('10.1000/', l_partkey % 3) AS main_doi, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2, 3)) WHERE n = 1""")
def dedup_query(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citation_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("10.1000/"), F.col("l_partkey") % 3).alias("main_doi")).distinct().withColumn("pub_id", F.lit(None).cast("string"))
    return first_per_doi(rows, "citation_id", ["pos"]).select("citation_id", "pos", "main_doi")


@query("dedup_multi_doi", """WITH RECURSIVE x AS (SELECT DISTINCT l_orderkey AS c, CAST(l_linenumber AS INT) AS pos, CAST(l_suppkey AS VARCHAR) AS pub, CASE WHEN l_partkey % 5 = l_partkey % 7 THEN [CAST(l_partkey % 5 AS VARCHAR)] ELSE [CAST(l_partkey % 5 AS VARCHAR), CAST(l_partkey % 7 AS VARCHAR)] END AS dois FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY pos, pub, dois) AS k, count(*) OVER (PARTITION BY c) AS many FROM x),
f AS (SELECT c, k, many, dois AS seen, concat(pos, ':', array_to_string(dois, '+')) AS kept FROM n WHERE k = 1
  UNION ALL SELECT n.c, n.k, n.many, CASE WHEN list_has_any(f.seen, n.dois) THEN f.seen ELSE list_concat(f.seen, n.dois) END, CASE WHEN list_has_any(f.seen, n.dois) THEN f.kept ELSE concat(f.kept, ',', n.pos, ':', array_to_string(n.dois, '+')) END FROM f JOIN n ON n.c = f.c AND n.k = f.k + 1)
SELECT c AS citation_id, kept FROM f WHERE k = many""")
def dedup_multi_query(spark, sf_dir):
    kind = "struct<pos: int, pub_id: string, dois: array<string>>"
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citation_id"), F.struct(F.col("l_linenumber").cast("int").alias("pos"), F.col("l_suppkey").cast("string").alias("pub_id"), F.array_distinct(F.array((F.col("l_partkey") % 5).cast("string"), (F.col("l_partkey") % 7).cast("string"))).alias("dois")).alias("x"))
    per = rows.groupBy("citation_id").agg(F.array_sort(F.collect_set("x")).cast(f"array<{kind}>").alias("xs"))
    return per.select("citation_id", F.array_join(F.transform(greedy_unique(F.col("xs"), kind), lambda x: F.concat_ws(":", x["pos"], F.array_join(x["dois"], "+"))), ",").alias("kept"))


# formatted citations, payloads

_AUTHORS_SQL = "concat(surname, ', A., ', surname2, ', B.')"
_APA_SQL = {
    "openalex": f"concat({_AUTHORS_SQL}, ' (', pub_year, '). ', title, '. ', journal, ', ', volume, ' (', issue, ') ', first_page, '-', last_page, '. DOI: ', doi)",
    "openaire": f"concat({_AUTHORS_SQL}, ' (', pub_year, '). ', title, '. ', journal, ', ', volume, ' ', first_page, '-', last_page, '. DOI: ', doi, CASE WHEN work_id % 4 = 0 THEN concat('. Alternative DOIs: ', doi, '.v2') ELSE '' END)",
    "pubmed": f"concat({_AUTHORS_SQL}, ' (', pub_year, '). ', title, '. ', journal, ', ', volume, '(', issue, ') ', first_page, '-', last_page, '. DOI: ', doi)",
    "crossref": f"concat({_AUTHORS_SQL}, ' (', pub_year, '). ', title, '. ', journal, ': Press. ', first_page, '-', last_page, '. DOI: ', doi)",
    "hal": f"concat({_AUTHORS_SQL}, ' (', pub_year, '). ', title, '. ', journal, ', ', volume, ' (', issue, ') pp. ', first_page, '-', last_page, '. DOI: ', doi)",
}
_ID_SQL = {"openalex": "concat('W', work_id)", "openaire": "concat('oa::', work_id)", "pubmed": "CAST(work_id + 100000 AS VARCHAR)", "crossref": "doi", "hal": "concat('hal-', work_id)"}

for _api in SOURCES:

    @query(f"apa_{_api}", f"SELECT {_ID_SQL[_api]} AS pub_id, {_APA_SQL[_api]} AS apa FROM works")
    def apa_query(spark, sf_dir, api=_api):
        return publications(spark, sf_dir, api, every=True).select("pub_id", apa_citation().alias("apa"))


@query("parse_openalex_json", "SELECT concat('W', work_id) AS pub_id, title, surname AS first_author, pub_year AS publication_year, journal, volume, first_page AS page_first, doi AS main_doi FROM works")
def parse_json_query(spark, sf_dir):
    c = F.col
    payload = F.to_json(F.struct(F.concat(F.lit("https://openalex.org/W"), "work_id").alias("id"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), "title", c("pub_year").cast("int").alias("publication_year"), F.array(F.struct(c("surname").alias("raw_author_name"))).alias("authorships"), F.struct(F.struct(c("journal").alias("display_name")).alias("source")).alias("primary_location"), F.struct("volume", "issue", "first_page", "last_page").alias("biblio")))
    p = parse_publications(works(spark, sf_dir).select(payload.alias("payload")), "openalex")
    return p.select("pub_id", "title", F.col("authors")[0].alias("first_author"), "publication_year", "journal", "volume", "page_first", "main_doi")


@query("parse_pubmed_xml", "SELECT CAST(work_id AS VARCHAR) AS pub_id, title, concat(surname, ', A.') AS first_author, pub_year AS publication_year, journal, volume, first_page AS page_first, last_page AS page_last, doi AS main_doi FROM works")
def parse_xml_query(spark, sf_dir):
    xml = F.format_string(
        "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>%s</PMID><Article><Journal><JournalIssue><Volume>%s</Volume><Issue>%s</Issue><PubDate><MedlineDate>%s Jan-Feb</MedlineDate></PubDate></JournalIssue><Title>%s</Title></Journal><ArticleTitle>%s</ArticleTitle><Pagination><MedlinePgn>%s-%s</MedlinePgn></Pagination><ELocationID EIdType='doi'>%s</ELocationID><AuthorList><Author><LastName>%s</LastName><Initials>A</Initials></Author></AuthorList></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>",
        F.col("work_id").cast("string"), "volume", "issue", "pub_year", "journal", "title", "first_page", "last_page", "doi", "surname",
    )
    p = parse_publications(spread(works(spark, sf_dir)).select(xml.alias("payload")), "pubmed")
    return p.select("pub_id", "title", F.col("authors")[0].alias("first_author"), "publication_year", "journal", "volume", "page_first", "page_last", "main_doi")


# records of the other three sources as JSON; {} are columns of works
_JSON = {
    "openaire": """SELECT to_json(named_struct('id', concat('oa::', work_id), 'mainTitle', title, 'publicationDate', concat(pub_year, '-05-01'), 'authors', array(named_struct('fullName', surname), named_struct('fullName', ''), named_struct('fullName', surname2)),
        'container', named_struct('name', journal, 'vol', volume, 'iss', issue, 'sp', first_page, 'ep', last_page), 'pids', array(named_struct('scheme', 'handle', 'value', '1/2'), named_struct('scheme', 'doi', 'value', IF(work_id % 5 = 0, 'none', doi))),
        'instances', array(named_struct('pids', array(named_struct('scheme', 'doi', 'value', doi), named_struct('scheme', 'doi', 'value', concat('https://doi.org/', doi, '.v2'))))))) AS payload FROM {works}""",
    "crossref": """SELECT to_json(named_struct('DOI', doi, 'title', array(title), 'author', array(named_struct('given', 'A.', 'family', surname), named_struct('given', CAST(NULL AS STRING), 'family', surname2)), 'issued', named_struct('date-parts', array(array(CAST(pub_year AS INT), 3))),
        'container-title', IF(work_id % 5 = 0, CAST(array() AS ARRAY<STRING>), array(journal)), 'publisher', 'Press', 'volume', volume, 'issue', issue, 'page', concat(first_page, '-', last_page))) AS payload FROM {works}""",
    "hal": """SELECT to_json(named_struct('halId_s', concat('hal-', work_id), 'doiId_s', IF(work_id % 5 = 0, 'none', doi), 'title_s', array(title), 'authFullName_s', array(surname, surname2), 'conferenceStartDateY_i', IF(work_id % 3 = 0, CAST(pub_year AS INT), NULL), 'publicationDateY_i', CAST(pub_year AS INT) + 1,
        'journalTitle_s', IF(work_id % 4 = 0, NULL, journal), 'bookTitle_s', title, 'page_s', concat(first_page, '-', last_page), 'volume_s', volume, 'issue_s', array(issue))) AS payload FROM {works}""",
}
_PARSED_SQL = {
    "openaire": "SELECT concat('oa::', work_id) AS pub_id, title, concat(surname, ';', surname2) AS authors, pub_year AS publication_year, journal, volume, issue, first_page AS page_first, last_page AS page_last, doi AS main_doi, concat(doi, '.v2') AS alternatives FROM works",
    "crossref": "SELECT doi AS pub_id, title, concat('A. ', surname, ';', surname2) AS authors, pub_year AS publication_year, CASE WHEN work_id % 5 <> 0 THEN journal END AS journal, volume, issue, first_page AS page_first, last_page AS page_last, doi AS main_doi, '' AS alternatives FROM works",
    "hal": "SELECT concat('hal-', work_id) AS pub_id, title, concat(surname, ';', surname2) AS authors, CAST(CAST(pub_year AS INT) + CASE WHEN work_id % 3 = 0 THEN 0 ELSE 1 END AS VARCHAR) AS publication_year, CASE WHEN work_id % 4 = 0 THEN title ELSE journal END AS journal, volume, issue, first_page AS page_first, last_page AS page_last, CASE WHEN work_id % 5 <> 0 THEN doi END AS main_doi, '' AS alternatives FROM works",
}

for _api in _JSON:

    @query(f"parse_{_api}_json", _PARSED_SQL[_api])
    def parse_records_query(spark, sf_dir, api=_api):
        p = parse_publications(spark.sql(_JSON[api], works=works(spark, sf_dir)), api)
        return p.select("pub_id", "title", F.array_join("authors", ";").alias("authors"), "publication_year", "journal", "volume", "issue", "page_first", "page_last", "main_doi", F.array_join("alternative_dois", ";").alias("alternatives"))


@query("journal_ids", """WITH s AS (SELECT journal AS display_name, min(work_id) AS rank, concat('S', min(work_id)) AS source_id FROM works GROUP BY journal),
n AS (SELECT DISTINCT CASE work_id % 4 WHEN 0 THEN journal WHEN 1 THEN upper(journal) WHEN 2 THEN replace(replace(journal, 'Journal of ', ''), ' systems', ': Systems') ELSE concat(journal, ' and others') END AS name FROM works)
SELECT name, arg_min(source_id, rank) AS source_id FROM n LEFT JOIN s ON list_has_all(string_split(lower(display_name), ' '), string_split(replace(lower(name), ':', ''), ' ')) GROUP BY name""")
def journal_ids_query(spark, sf_dir):
    w = works(spark, sf_dir)
    sources = w.groupBy(F.col("journal").alias("display_name")).agg(F.min("work_id").alias("rank"), F.concat(F.lit("S"), F.min("work_id")).alias("source_id"))
    k, short = F.col("work_id") % 4, F.replace(F.replace("journal", F.lit("Journal of "), F.lit("")), F.lit(" systems"), F.lit(": Systems"))
    names = w.select(F.when(k == 0, F.col("journal")).when(k == 1, F.upper("journal")).when(k == 2, short).otherwise(F.concat("journal", F.lit(" and others"))).alias("name"))
    return resolve_journals(names, sources).select("name", "source_id")


# ranking, voting, evaluation

_SCORED = "SELECT l_orderkey AS citation_id, CAST(l_linenumber AS INT) AS pos, min(l_quantity) > 15 AS sel_label, round(0.5 + min(l_discount) * 5, 4)::DOUBLE AS sel_score, round(min(l_tax) * 10 + l_linenumber / 1000.0, 4)::DOUBLE AS similarity FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _scored(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("citation_id"), F.col("l_linenumber").cast("int").alias("pos"))
    return rows.agg((F.min("l_quantity") > 15).alias("sel_label"), F.round(F.lit(0.5) + F.min("l_discount") * 5, 4).alias("sel_score"), F.round(F.min("l_tax") * 10 + F.col("pos") / 1000.0, 4).alias("similarity"))


@query("rank_decide", f"""WITH s AS ({_SCORED}),
a AS (SELECT *, count(*) OVER w AS n, count_if(sel_label) OVER w AS n_yes, count_if(sel_label AND sel_score >= 0.9) OVER w AS n_sure, max(CASE WHEN sel_label AND sel_score >= 0.9 THEN sel_score END) OVER w AS top FROM s WINDOW w AS (PARTITION BY citation_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY CASE WHEN sel_label AND sel_score >= 0.9 AND top - sel_score <= 0.01 THEN 0 ELSE 1 END, similarity DESC, pos) AS r_tied,
  row_number() OVER (PARTITION BY citation_id ORDER BY CASE WHEN sel_label AND sel_score < 0.9 THEN 0 ELSE 1 END, similarity DESC, pos) AS r_unsure, row_number() OVER (PARTITION BY citation_id ORDER BY similarity DESC, pos) AS r_any FROM a),
d AS (SELECT citation_id, any_value(n) AS n, any_value(n_yes) AS n_yes, any_value(n_sure) AS n_sure,
  max(CASE WHEN r_tied = 1 THEN pos END) AS tied, max(CASE WHEN r_tied = 1 THEN sel_score END) AS tied_score, max(CASE WHEN r_unsure = 1 THEN pos END) AS unsure, max(CASE WHEN r_unsure = 1 THEN similarity END) AS unsure_sim,
  max(CASE WHEN r_any = 1 THEN pos END) AS anyone, max(CASE WHEN r_any = 1 THEN similarity END) AS any_sim, max(sel_score) AS one_score, max(similarity) AS one_sim FROM p GROUP BY citation_id)
SELECT citation_id,
  CASE WHEN n = 1 THEN CASE WHEN n_yes = 1 AND one_score < 0.9 AND one_sim < 0.6 THEN NULL ELSE anyone END WHEN n_yes = 0 THEN NULL WHEN n_sure > 0 THEN tied WHEN unsure_sim >= 0.6 THEN unsure WHEN any_sim >= 0.6 THEN anyone END AS pos,
  CASE WHEN n = 1 THEN CASE WHEN n_yes = 1 AND one_score < 0.9 THEN CASE WHEN one_sim >= 0.6 THEN one_sim END ELSE one_score END WHEN n_yes = 0 THEN NULL WHEN n_sure > 0 THEN tied_score WHEN unsure_sim >= 0.6 THEN unsure_sim WHEN any_sim >= 0.6 THEN any_sim END AS score FROM d""")
def decide_query(spark, sf_dir):
    return decide(_scored(spark, sf_dir)).select("citation_id", "pos", "score")


_RESULTS = """SELECT citation_id, a.api, a.o, CASE WHEN (citation_id + a.o) % 4 = 0 THEN NULL WHEN (citation_id + a.o) % 5 = 0 THEN concat(doi, '.x') ELSE doi END AS main_doi, CASE WHEN a.api = 'openaire' THEN concat(doi, '.v2') END AS alt, concat(a.api, '-', work_id) AS pub_id
FROM cites, (VALUES ('openalex', 1), ('openaire', 2), ('pubmed', 3), ('crossref', 4), ('hal', 5)) a(api, o)"""
_APIS = ["openalex", "openaire", "pubmed", "crossref", "hal"]


def _results(spark, sf_dir) -> DataFrame:
    rows = cites(spark, sf_dir).select("citation_id", "citation", "work_id", "doi", F.posexplode(F.array(*map(F.lit, _APIS))).alias("p", "api")).withColumn("o", F.col("p") + 1)
    k = F.col("citation_id") + F.col("o")
    main = F.when(k % 4 == 0, None).when(k % 5 == 0, F.concat("doi", F.lit(".x"))).otherwise(F.col("doi"))
    alternatives = F.when((F.col("api") == "openaire") & main.isNotNull(), F.array(F.concat("doi", F.lit(".v2")))).otherwise(F.array().cast("array<string>"))
    return rows.select("citation_id", "citation", "work_id", "doi", "api", "o", main.alias("main_doi"), alternatives.alias("alternative_dois"), F.concat_ws("-", "api", "work_id").alias("pub_id"))


_VOTES_SQL = f"""r AS ({_RESULTS}), v AS (SELECT citation_id, o * 2 AS seen, main_doi AS doi FROM r WHERE main_doi IS NOT NULL UNION ALL SELECT citation_id, o * 2 + 1, alt FROM r WHERE alt IS NOT NULL AND main_doi IS NOT NULL),
c AS (SELECT citation_id, doi, count(*) AS n_votes, min(seen) AS seen FROM v GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY n_votes DESC, seen) AS k, count(*) OVER (PARTITION BY citation_id) AS n_dois FROM c)"""


@query("ensemble_vote", f"WITH {_VOTES_SQL} SELECT citation_id, doi AS selected_doi, n_votes, n_dois FROM e WHERE k = 1")
def vote_query(spark, sf_dir):
    return elect(votes(_results(spark, sf_dir).where("main_doi is not null"), _APIS)).select("citation_id", "selected_doi", "n_votes", "n_dois")


@query("ensemble_backfill", f"""WITH {_VOTES_SQL}, w AS (SELECT citation_id, doi FROM e WHERE k = 1)
SELECT w.citation_id, r.api, CASE WHEN r.main_doi IS NOT NULL THEN r.pub_id ELSE concat('W', x.work_id) END AS pub_id FROM w JOIN r ON w.citation_id = r.citation_id LEFT JOIN works x ON w.doi = x.doi AND r.api = 'openalex' WHERE r.main_doi IS NOT NULL OR x.work_id IS NOT NULL""")
def backfill_query(spark, sf_dir):
    results = _results(spark, sf_dir).where("main_doi is not null")
    pubs = publications(spark, sf_dir, "openalex")
    return backfill(elect(votes(results, _APIS)), results, pubs, _APIS)


@query("ensemble_admitted", f"""WITH r AS ({_RESULTS}) SELECT citation_id, api FROM r WHERE main_doi IS NOT NULL AND (api = 'openaire' OR citation_id % 10 >= 6)""")
def admitted_query(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumns({"apa": F.when(F.col("api") != "openaire", F.col("citation")), "similarity": (F.col("citation_id") % 10) / 10})
    return admit(rows).select("citation_id", "api")


@query("evaluate_results", f"""WITH r AS ({_RESULTS}), g AS (SELECT citation, max(doi) AS doi, max(work_id) AS work_id FROM cites GROUP BY citation),
x AS (SELECT r.*, g.doi, CASE WHEN r.api = 'crossref' THEN g.doi ELSE concat(r.api, '-', g.work_id) END AS expected FROM r JOIN cites c ON r.citation_id = c.citation_id JOIN g ON c.citation = g.citation)
SELECT citation_id, api, expected, CASE WHEN main_doi IS NOT NULL AND (main_doi = doi OR alt = doi OR api <> 'crossref' AND expected = pub_id) THEN 'CORRECT' ELSE 'INCORRECT' END AS final_evaluation FROM x""")
def evaluate_query(spark, sf_dir):
    """The join of results with a gold standard by the citation's text, and the verdicts."""
    named = [F.concat(F.lit(f"{a}-"), F.max("work_id")).alias(a) for a in ("openalex", "openaire", "pubmed", "hal")]
    gold = cites(spark, sf_dir).groupBy("citation").agg(F.max("doi").alias("doi"), *named)
    rows = _results(spark, sf_dir).withColumn("status", F.when(F.col("main_doi").isNull(), "NO_RESULT").otherwise("RESULT"))
    return evaluate(rows, gold).select("citation_id", "api", "expected", "final_evaluation")


_VERDICTS = f"""r AS ({_RESULTS}), e AS (SELECT r.citation_id, r.api, CASE WHEN r.citation_id % 23 = 5 THEN 'ERROR' WHEN r.main_doi IS NULL THEN 'NO_RESULT' ELSE 'RESULT' END AS status, CASE WHEN r.citation_id % 6 = 1 THEN NULL ELSE c.doi END AS gold_doi, CASE WHEN r.citation_id % 6 = 1 THEN NULL WHEN r.api = 'crossref' THEN c.doi ELSE concat(r.api, '-', c.work_id + CASE WHEN r.citation_id % 9 = 0 THEN 1 ELSE 0 END) END AS expected, r.main_doi, r.pub_id FROM r JOIN cites c ON r.citation_id = c.citation_id),
x AS (SELECT *, CASE WHEN status = 'ERROR' THEN 'ERROR' WHEN status = 'NO_RESULT' THEN CASE WHEN expected IS NULL THEN 'CORRECT' ELSE 'INCORRECT' END WHEN main_doi = gold_doi OR (api <> 'crossref' AND expected = pub_id) THEN 'CORRECT' ELSE 'INCORRECT' END AS final_evaluation FROM e)"""


def _evaluated(spark, sf_dir) -> DataFrame:
    k = F.col("citation_id")
    r = _results(spark, sf_dir).withColumn("status", F.when(k % 23 == 5, "ERROR").when(F.col("main_doi").isNull(), "NO_RESULT").otherwise("RESULT"))
    own = F.when(F.col("api") == "crossref", F.col("doi")).otherwise(F.concat_ws("-", "api", F.col("work_id") + F.when(k % 9 == 0, 1).otherwise(0)))
    r = r.withColumn("gold_doi", F.when(k % 6 != 1, F.col("doi"))).withColumn("expected", F.when(k % 6 != 1, own))
    none = F.lit(None).cast("string")
    return r.withColumn("final_evaluation", final_evaluation(F.col("api"), F.col("status"), F.col("pub_id"), F.col("main_doi"), F.array().cast("array<string>"), F.col("gold_doi"), F.col("expected"), none))


@query("final_evaluation", f"WITH {_VERDICTS} SELECT citation_id, api, final_evaluation FROM x")
def verdict_query(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("citation_id", "api", "final_evaluation")


@query("classification_metrics", f"""WITH {_VERDICTS}
SELECT a.api, count(x.api) AS total, count(*) FILTER (WHERE final_evaluation = 'CORRECT') AS correct, count(*) FILTER (WHERE final_evaluation = 'CORRECT' AND status = 'RESULT') AS correct_match, count(*) FILTER (WHERE final_evaluation = 'CORRECT' AND status <> 'RESULT') AS correct_no_result, count(*) FILTER (WHERE final_evaluation = 'INCORRECT') AS incorrect,
  count(*) FILTER (WHERE final_evaluation = 'INCORRECT' AND status = 'RESULT' AND expected IS NOT NULL) AS incorrect_match, count(*) FILTER (WHERE final_evaluation = 'INCORRECT' AND status <> 'RESULT' AND expected IS NOT NULL) AS incorrect_missing, count(*) FILTER (WHERE final_evaluation = 'INCORRECT' AND status = 'RESULT' AND expected IS NULL) AS incorrect_spurious,
  round(coalesce(count(*) FILTER (WHERE final_evaluation = 'CORRECT') / nullif(count(x.api), 0), 0), 6)::DOUBLE AS accuracy
FROM (VALUES ('openalex'), ('openaire'), ('pubmed'), ('crossref'), ('hal'), ('ensemble')) a(api) LEFT JOIN x ON a.api = x.api AND x.final_evaluation <> 'ERROR' GROUP BY a.api""")
def metrics_query(spark, sf_dir):
    return metrics(_evaluated(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


_CELLS = ", ".join(f"coalesce(max(CASE WHEN x.api = '{a}' THEN final_evaluation END), '') AS \"{DISPLAY[a]}_Status\", coalesce(max(CASE WHEN x.api = '{a}' THEN main_doi END), '') AS \"{DISPLAY[a]}_DOI\"" for a in DISPLAY)


@query("comparison_pivot", f"""WITH {_VERDICTS}
SELECT x.citation_id, any_value(CASE WHEN length(c.citation) > 80 THEN concat(left(c.citation, 80), '...') ELSE c.citation END) AS citation, {_CELLS} FROM x JOIN cites c ON x.citation_id = c.citation_id GROUP BY x.citation_id""")
def pivot_query(spark, sf_dir):
    return comparison(_evaluated(spark, sf_dir))


def _labelled(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars") > 300)
    d = d.toDF("doc_id", "predicted")
    return d.join(_read(spark, sf_dir, "labels"), "doc_id").select("predicted", (F.col("quality") == 1).alias("actual"))


@query("precision_recall", """
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6)::DOUBLE AS "precision", round(tp / (tp + fn), 6)::DOUBLE AS recall, round(tn / (tn + fp), 6)::DOUBLE AS specificity, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1
FROM (SELECT count_if(n_chars > 300 AND quality = 1) AS tp, count_if(n_chars > 300 AND quality <> 1) AS fp, count_if(n_chars <= 300 AND quality = 1) AS fn, count_if(n_chars <= 300 AND quality <> 1) AS tn FROM documents JOIN labels USING (doc_id))""")
def precision_query(spark, sf_dir):
    out = precision_recall(_labelled(spark, sf_dir), "predicted", "actual")
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity", "f1")))


_BINNED = f"s AS ({_SCORED}), b AS (SELECT CAST(floor(similarity * 10) AS INT) AS bin, count(*) AS n, avg(similarity) AS mean_score, avg(CASE WHEN sel_label THEN 1.0 ELSE 0.0 END) AS accuracy FROM s WHERE similarity >= 0 AND similarity < 1 GROUP BY 1)"


@query("calibration_bins", f"WITH {_BINNED} SELECT bin, n, round(mean_score, 6)::DOUBLE AS mean_score, round(accuracy, 6)::DOUBLE AS accuracy FROM b")
def calibration_query(spark, sf_dir):
    return calibration(_scored(spark, sf_dir), "similarity", "sel_label").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("accuracy", 6).alias("accuracy"))


@query("calibration_ece", f"WITH {_BINNED} SELECT round(sum(n * abs(mean_score - accuracy)) / sum(n), 6)::DOUBLE AS ece, round(max(abs(mean_score - accuracy)), 6)::DOUBLE AS mce FROM b")
def ece_query(spark, sf_dir):
    return expected_error(calibration(_scored(spark, sf_dir), "similarity", "sel_label")).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query("compare_runs", f"""WITH s AS ({_SCORED}), a AS (SELECT count(*) AS n, avg(CASE WHEN sel_label THEN 1.0 ELSE 0 END) AS m, var_samp(CASE WHEN sel_label THEN 1.0 ELSE 0 END) AS v FROM s), b AS (SELECT count(*) AS n, avg(CASE WHEN sel_score > 0.7 THEN 1.0 ELSE 0 END) AS m, var_samp(CASE WHEN sel_score > 0.7 THEN 1.0 ELSE 0 END) AS v FROM s)
SELECT a.n AS n_a, b.n AS n_b, round(a.m, 6)::DOUBLE AS accuracy_a, round(b.m, 6)::DOUBLE AS accuracy_b, round((b.m - a.m) / sqrt(a.v / a.n + b.v / b.n), 4)::DOUBLE AS t FROM a, b""")
def compare_query(spark, sf_dir):
    s = _scored(spark, sf_dir)
    out = compare_runs(s.select(F.col("sel_label").alias("correct")), s.select((F.col("sel_score") > 0.7).alias("correct")))
    return out.select("n_a", "n_b", F.round("accuracy_a", 6).alias("accuracy_a"), F.round("accuracy_b", 6).alias("accuracy_b"), F.round("t", 4).alias("t"))


@query("compare_runs_p", f"""WITH RECURSIVE s AS ({_SCORED}), g AS (SELECT CASE WHEN sel_score > 0.75 THEN 1 ELSE 0 END AS a, CASE WHEN similarity > 0.5 THEN 1 ELSE 0 END AS b FROM s),
w AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) / count(*) AS ea, var_samp(b) / count(*) AS eb FROM g),
t AS (SELECT (mb - ma) / sqrt(ea + eb) AS t, (ea + eb) * (ea + eb) / ((ea * ea + eb * eb) / (n - 1)) AS f FROM w),
z AS (SELECT t, f, f / (f + t * t) AS x0, CASE WHEN f / (f + t * t) < (f / 2 + 1) / (f / 2 + 2.5) THEN f / (f + t * t) ELSE t * t / (f + t * t) END AS x, CASE WHEN f / (f + t * t) < (f / 2 + 1) / (f / 2 + 2.5) THEN f / 2 ELSE 0.5 END AS p, CASE WHEN f / (f + t * t) < (f / 2 + 1) / (f / 2 + 2.5) THEN 0.5 ELSE f / 2 END AS q FROM t),
r AS (SELECT 400 AS k, x, p, q, 0.0::DOUBLE AS v FROM z
  UNION ALL SELECT k - 1, x, p, q, CASE WHEN k % 2 = 0 THEN (k // 2) * (q - k // 2) * x / ((p + k - 1) * (p + k)) ELSE -(p + k // 2) * (p + q + k // 2) * x / ((p + k - 1) * (p + k)) END / (1 + v) FROM r WHERE k > 0)
SELECT round(t, 6)::DOUBLE AS t, round(f, 4)::DOUBLE AS freedom, round(CASE WHEN x0 = z.x THEN y ELSE 1 - y END, 9)::DOUBLE AS p_value
FROM z, (SELECT exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(x) + q * ln(1 - x)) / p / (1 + v) AS y FROM r WHERE k = 0)""")
def compare_p_query(spark, sf_dir):
    s = _scored(spark, sf_dir)
    out = compare_runs(s.select((F.col("sel_score") > 0.75).alias("correct")), s.select((F.col("similarity") > 0.5).alias("correct")))
    return out.select(F.round("t", 6).alias("t"), F.round("freedom", 4).alias("freedom"), F.round("p_value", 9).alias("p_value"))


# the model of pairs


def _year_pairs(spark, sf_dir) -> DataFrame:
    """Citations and all publications of their journal and year."""
    c = cites(spark, sf_dir).select("citation_id", entity_struct().alias("e"))
    p = publications(spark, sf_dir, "openalex")
    return c.join(p, (F.col("e.journal") == p["journal"]) & (F.col("e.publication_year") == p["publication_year"]))


_PATTERNS = """w AS (SELECT *, list_distinct(string_split(lower(title), ' ')) AS tokens FROM works),
x AS (SELECT concat(CASE WHEN c.raw_doi IS NULL OR NOT (citation_id % 4 = 1 OR citation_id % 11 <> 2) THEN '2' WHEN c.doi = w.doi THEN '1' ELSE '0' END,
  CASE WHEN len(list_intersect(list_distinct(string_split(lower(c.title), ' ')), tokens)) / len(list_distinct(list_concat(list_distinct(string_split(lower(c.title), ' ')), tokens))) >= 0.8 THEN '1' ELSE '0' END,
  CASE WHEN CASE citation_id % 6 WHEN 4 THEN false WHEN 2 THEN c.surname = w.surname OR c.surname2 = w.surname2 ELSE c.surname = w.surname END THEN '1' ELSE '0' END, '11',
  CASE WHEN c.volume = w.volume THEN '1' ELSE '0' END, CASE WHEN c.issue = w.issue THEN '1' ELSE '0' END, CASE WHEN c.first_page = w.first_page THEN '1' ELSE '0' END, CASE WHEN suffix(w.last_page, raw_last) THEN '1' ELSE '0' END) AS pattern
  FROM cites c JOIN w ON c.journal = w.journal AND c.raw_year = w.pub_year)"""


@query("pair_patterns", f"WITH {_PATTERNS} SELECT pattern, count(*) AS n FROM x GROUP BY pattern")
def patterns_query(spark, sf_dir):
    return count_patterns(with_pattern(_year_pairs(spark, sf_dir)))


@query("pair_matches")
def matches_query(spark, sf_dir):
    """Each citation and publication of its journal and year with the probability that they match, by a model of all such pairs; tests hold the model against a plain loop."""
    pairs = settled(with_pattern(_year_pairs(spark, sf_dir)).select("citation_id", "pub_id", "pattern"))
    return pairs.select("citation_id", "pub_id", F.round(fit_pairs(pairs).probability(F.col("pattern")), 6).alias("probability"))


# caching and resuming


@query("cache_distinct", "SELECT DISTINCT md5(concat(citation, '|openalex|simple')) AS key, citation FROM cites")
def cache_query(spark, sf_dir):
    return cites(spark, sf_dir).select("citation").distinct().select(cache_key(F.col("citation"), F.lit("openalex"), F.lit("simple")).alias("key"), "citation")


@query("cache_hit_rate", """
SELECT count(*) AS total, count(*) - count(DISTINCT title) AS hits FROM cites""")
def hit_rate_query(spark, sf_dir):
    return hit_rate(cites(spark, sf_dir), ["title"]).select("total", "hits")


@query("cache_store_stats", """
WITH k AS (SELECT DISTINCT citation FROM cites WHERE raw_doi IS NOT NULL)
SELECT 3 AS version, (SELECT count(*) FROM k) AS entries, count(*) AS asked, count(k.citation) AS hits, count(*) - count(k.citation) AS misses, concat(round(100 * count(k.citation) / count(*), 1), '%') AS rate
FROM cites LEFT JOIN k USING (citation)""")
def store_query(spark, sf_dir):
    """Two runs put results, with some citations in both; then all citations are looked up."""
    c = cites(spark, sf_dir)
    keyed = c.select(cache_key(F.col("citation"), F.lit("openalex"), F.lit("simple")).alias("key"), "citation_id", "doi", "raw_doi")
    store = ResultStore(spark, new_place(spark, "results"), ["key"], "key string, doi string")
    store.put(keyed.where("raw_doi is not null").select("key", "doi").distinct())
    store.put(keyed.where("raw_doi like 'https%'").select("key", "doi").distinct())
    store.look_up(keyed.select("key"))
    return store.stats().drop("entry_limit")


@query("resume_pending", "SELECT citation_id FROM cites WHERE citation_id % 4 <> 0")
def resume_query(spark, sf_dir):
    c = cites(spark, sf_dir).select("citation_id")
    return not_yet_done(c, c.where("citation_id % 4 = 0"), ["citation_id"])


# whole pipelines


def _engine(spark, sf_dir, apis=("openalex",)) -> Engine:
    return Engine({a: publications(spark, sf_dir, a) for a in apis}, RuleBackend())


@query("link_citations")
def link_query(spark, sf_dir):
    c = cites(spark, sf_dir).select("citation_id", "citation")
    return _engine(spark, sf_dir).link(c, "openalex").select("citation_id", "status", "score", "reason", "pub_id", "main_doi", "apa", "uri")


@query("link_ensemble")
def ensemble_query(spark, sf_dir):
    apis = tuple(SOURCES)
    c = cites(spark, sf_dir).select("citation_id", "citation")
    out = _engine(spark, sf_dir, apis).link_ensemble(c, apis)
    return out.select("citation_id", "selected_doi", "n_votes", "n_dois", F.array_join(F.transform(F.map_entries("external_ids"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("external_ids"))


@query("extract_and_link")
def fulltext_query(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    engine.normalize_ids = True
    refs, _, _ = engine.extract_and_link(document_text(spark, sf_dir))
    return refs.select("doc_id", "id", "text", "start", "end", "status", "pub_id", F.size("claims_in_context").alias("n_claims"))


from refloom.plans import remote_queries  # noqa: E402, F401  registers its queries
from refloom.plans import more_queries  # noqa: E402, F401
