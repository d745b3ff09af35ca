"""Citations and catalogs projected from part and orders, in SQL that Spark and DuckDB both run.

The tables {part} and {orders} are placeholders for the given ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.sources.payloads import PUBLICATION

WORKS = """
SELECT p_partkey AS work_id,
       concat('Study of ', p_name, ' under ', lower(p_type), ' load case ', CAST(p_partkey AS VARCHAR(20))) AS title,
       concat('Surname', substring('abcdefghijklmnopqrstuvwxyz', CAST(p_partkey % 26 + 1 AS INT), 1)) AS surname,
       concat('Coauthor', substring('abcdefghijklmnopqrstuvwxyz', CAST(p_partkey % 7 + 1 AS INT), 1)) AS surname2,
       CAST(1980 + p_partkey % 40 AS VARCHAR(20)) AS pub_year,
       concat('Journal of ', lower(p_type), ' systems') AS journal,
       CAST(p_size AS VARCHAR(20)) AS volume, CAST(p_partkey % 12 + 1 AS VARCHAR(20)) AS issue,
       CAST(100 + p_partkey % 800 AS VARCHAR(20)) AS first_page, CAST(100 + p_partkey % 800 + 9 AS VARCHAR(20)) AS last_page,
       concat('10.', CAST(1000 + p_partkey % 9000 AS VARCHAR(20)), '/', lower(replace(p_brand, '#', '.')), '.', CAST(p_partkey AS VARCHAR(20))) AS doi
FROM {part}
"""

_CITED = """
SELECT o_orderkey AS citation_id, work_id, doi, title, surname, surname2, pub_year, journal, volume, issue, first_page, last_page,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN concat('https://doi.org/', doi) WHEN o_orderkey % 11 = 2 THEN concat('DOI:', upper(doi), '/') ELSE doi END AS raw_doi,
       CASE WHEN o_orderkey % 5 = 0 THEN upper(title) WHEN o_orderkey % 13 = 4 THEN concat('"', title, '".  ') ELSE title END AS raw_title,
       CASE o_orderkey % 6 WHEN 0 THEN concat(surname, ', A.') WHEN 1 THEN concat('A. ', surname, ' et al.') WHEN 2 THEN concat(surname, ', A. ; ', surname2, ', B.') WHEN 3 THEN concat(surname, ' A.') WHEN 4 THEN concat('Anna ', surname) ELSE concat('Anna Maria ', surname, ' (Institute)') END AS raw_authors,
       CAST(CAST(pub_year AS INT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) AS raw_year,
       CASE WHEN o_orderkey % 2 = 0 THEN substring(last_page, 2, 2) ELSE last_page END AS raw_last,
       CASE WHEN o_orderkey % 17 = 3 THEN concat('Order ', CAST(o_orderkey AS VARCHAR(20)), ' was shipped on time')
            ELSE concat(surname, ', A., ', surname2, ', B. (', CAST(CAST(pub_year AS INT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)), '). ',
                        CASE WHEN o_orderkey % 5 = 0 THEN upper(title) ELSE title END, '. ', journal, ', ', volume, ' (', issue, ') ', first_page, '-', last_page, '.',
                        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(' DOI: ', doi) END) END AS citation
"""

#: Citations of works: o_orderkey picks the work, and its residues what is spoilt.
CITES = f"""{_CITED}FROM {{orders}} o CROSS JOIN (SELECT count(*) AS n FROM {{part}}) c JOIN ({WORKS}) w ON o.o_orderkey % c.n = w.work_id
"""
#: The same for Spark, which would join orders with all works first where a filter or a join asks for a column made of both: none of its joins is without key.
_CITES_BY_KEY = f"""{_CITED}FROM (SELECT o_orderkey, o_orderkey % (SELECT nullif(count(*), 0) FROM {{part}}) AS work FROM {{orders}}) o JOIN ({WORKS}) w ON o.work = w.work_id
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WORKS, part=_table(spark, sf_dir, "part"))


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CITES_BY_KEY, part=_table(spark, sf_dir, "part"), orders=_table(spark, sf_dir, "orders"))


def publications(spark: SparkSession, sf_dir: str, api: str, every: bool = False) -> DataFrame:
    """A source's publications: each covers part of the works (every: all of them); OpenAIRE's have a second DOI now and then."""
    w = works(spark, sf_dir)
    k = F.col("work_id")
    covered = {"openalex": F.lit(True), "openaire": k % 10 < 8, "pubmed": k % 3 == 0, "crossref": k % 10 < 9, "hal": k % 50 == 0}[api]
    ids = {"openalex": F.concat(F.lit("W"), k), "openaire": F.concat(F.lit("oa::"), k), "pubmed": (k + 100000).cast("string"), "crossref": F.col("doi"), "hal": F.concat(F.lit("hal-"), k)}
    second = F.when((k % 4 == 0) & F.lit(api == "openaire"), F.array(F.concat("doi", F.lit(".v2")))).otherwise(F.array().cast("array<string>"))
    given = {"api": F.lit(api), "pub_id": ids[api], "title": F.col("title"), "authors": F.array(F.concat("surname", F.lit(", A.")), F.concat("surname2", F.lit(", B."))), "publication_year": F.col("pub_year"), "journal": F.col("journal"), "publisher": F.lit("Press"), "volume": F.col("volume"), "issue": F.col("issue"), "page_first": F.col("first_page"), "page_last": F.col("last_page"), "pages": F.concat_ws("-", "first_page", "last_page"), "main_doi": F.col("doi"), "alternative_dois": second}
    kinds = dict(x.strip().split(" ", 1) for x in PUBLICATION.split(", "))
    return w.where(F.lit(True) if every else covered).select(*(given[n].cast(t).alias(n) for n, t in kinds.items()))


def entity_struct() -> F.Column:
    """The parsed fields of a citation's raw columns, as operators take them."""
    return F.struct(F.col("raw_doi").alias("doi"), F.col("raw_title").alias("title"), F.col("raw_authors").alias("authors"), F.col("journal"), F.col("raw_year").alias("publication_year"), F.col("volume"), F.col("issue"), F.col("first_page").alias("page_first"), F.col("raw_last").alias("page_last"))


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with mentions and a reference list: (doc_id, text), ten citations of cites a document, each mentioned by number or by author and year."""
    c = cites(spark, sf_dir).select(F.floor(F.col("citation_id") / 10).alias("doc_id"), (F.col("citation_id") % 10).alias("k"), "citation", "surname", "raw_year")
    by_number = F.col("doc_id") % 2 == 0
    mark = F.concat(F.lit("["), F.col("k") + 1, F.lit("]"))
    said = F.when(by_number, F.concat(F.lit("Earlier work covers load case "), F.col("k"), F.lit(" "), mark, F.lit(" in detail."))).otherwise(F.concat(F.lit("Load case "), F.col("k"), F.lit(" was studied ("), F.col("surname"), F.lit(" et al., "), F.col("raw_year"), F.lit(") before.")))
    listed = F.when(by_number, F.concat(mark, F.lit(" "), F.col("citation"))).otherwise(F.col("citation"))
    per = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", said.alias("said"), listed.alias("listed")))).alias("x"))
    return per.select("doc_id", F.concat(F.lit("# Report\n\n"), F.array_join("x.said", " "), F.lit("\n\n# References\n\n"), F.array_join("x.listed", "\n")).alias("text"))
