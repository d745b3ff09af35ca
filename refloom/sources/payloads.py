"""Source payloads to one publication schema, and publications to APA-like citations.

Payloads arrive as strings (JSON, or XML for PubMed), so that a source's schema may grow without breaking a scan; the
fields wanted are read by path. Nothing here is a UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.doi import clean_doi, without_resolver
from refloom.functions.text import first_match, present, strip
from refloom.sources.spec import source

#: Columns of a publication.
PUBLICATION = "api string, pub_id string, title string, authors array<string>, publication_year string, journal string, publisher string, volume string, issue string, page_first string, page_last string, pages string, main_doi string, alternative_dois array<string>"

# DDL of what is read of each payload.
PAYLOADS = {
    "openalex": "id string, doi string, title string, publication_year string, authorships array<struct<raw_author_name: string>>, primary_location struct<source: struct<display_name: string>>, biblio struct<volume: string, issue: string, first_page: string, last_page: string>",
    "openaire": "id string, mainTitle string, publicationDate string, authors array<struct<fullName: string>>, container struct<name: string, vol: string, iss: string, sp: string, ep: string>, pids array<struct<scheme: string, value: string>>, instances array<struct<pids: array<struct<scheme: string, value: string>>>>",
    "crossref": "DOI string, title array<string>, author array<struct<given: string, family: string>>, issued struct<`date-parts`: array<array<string>>>, `container-title` array<string>, publisher string, volume string, issue string, page string",
    "hal": "halId_s string, doiId_s string, title_s array<string>, authFullName_s array<string>, conferenceStartDateY_i string, publicationStartDateY_i string, publicationDateY_i string, publicationDateY_s string, journalTitle_s string, bookTitle_s string, page_s string, volume_s string, issue_s array<string>",
}
# End of fixed values.

_NO_STRINGS = "array<string>"


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _pages(c: Column, k: int) -> Column:
    """A page range's first (0) or last (1) part."""
    return present(F.get(F.split(c, r"\s*[-–]\s*"), F.lit(k)))


def _publication(api: str, **fields: Column) -> list[Column]:
    kinds = dict(x.strip().split(" ", 1) for x in PUBLICATION.split(", "))
    given = {"api": F.lit(api)} | fields
    return [given.get(name, _none(kind)).cast(kind).alias(name) for name, kind in kinds.items()]


def _openalex(p: Column) -> list[Column]:
    return _publication("openalex", pub_id=F.replace(p["id"], F.lit("https://openalex.org/"), F.lit("")), title=p["title"], authors=p["authorships"]["raw_author_name"], publication_year=p["publication_year"], journal=p["primary_location"]["source"]["display_name"], volume=p["biblio"]["volume"], issue=p["biblio"]["issue"], page_first=p["biblio"]["first_page"], page_last=p["biblio"]["last_page"], main_doi=clean_doi(p["doi"]), alternative_dois=F.array().cast(_NO_STRINGS))


def _openaire(p: Column) -> list[Column]:
    doi_of = lambda pids: F.transform(F.filter(pids, lambda x: x["scheme"] == "doi"), lambda x: clean_doi(x["value"]))
    none = F.array().cast(_NO_STRINGS)
    own = F.coalesce(doi_of(p["pids"]), none)
    deep = F.coalesce(F.flatten(F.transform(p["instances"], lambda i: F.coalesce(doi_of(i["pids"]), none))), none)
    dois = F.array_distinct(F.array_compact(F.concat(own, deep)))
    return _publication("openaire", pub_id=p["id"], title=p["mainTitle"], authors=F.filter(p["authors"]["fullName"], lambda a: F.length(a) > 0), publication_year=F.substr(p["publicationDate"], F.lit(1), F.lit(4)), journal=p["container"]["name"], volume=p["container"]["vol"], issue=p["container"]["iss"], page_first=p["container"]["sp"], page_last=p["container"]["ep"], main_doi=F.get(dois, F.lit(0)), alternative_dois=F.slice(dois, F.lit(2), F.greatest(F.size(dois), F.lit(1))))


def _crossref(p: Column) -> list[Column]:
    names = F.transform(p["author"], lambda a: strip(F.concat_ws(" ", a["given"], a["family"])))
    return _publication("crossref", pub_id=p["DOI"], title=F.get(p["title"], F.lit(0)), authors=names, publication_year=F.get(F.get(p["issued"]["date-parts"], F.lit(0)), F.lit(0)), journal=F.get(p["container-title"], F.lit(0)), publisher=p["publisher"], volume=p["volume"], issue=p["issue"], page_first=_pages(p["page"], 0), page_last=_pages(p["page"], 1), pages=p["page"], main_doi=clean_doi(p["DOI"]), alternative_dois=F.array().cast(_NO_STRINGS))


def _hal(p: Column) -> list[Column]:
    return _publication("hal", pub_id=p["halId_s"], title=F.get(p["title_s"], F.lit(0)), authors=p["authFullName_s"], publication_year=F.coalesce(p["conferenceStartDateY_i"], p["publicationStartDateY_i"], p["publicationDateY_i"]), journal=F.coalesce(p["journalTitle_s"], p["bookTitle_s"]), volume=p["volume_s"], issue=F.get(p["issue_s"], F.lit(0)), page_first=_pages(p["page_s"], 0), page_last=_pages(p["page_s"], 1), pages=p["page_s"], main_doi=clean_doi(p["doiId_s"]), alternative_dois=F.array().cast(_NO_STRINGS))


_ARTICLE = "//PubmedArticle[1]/MedlineCitation/Article"
_ISSUE = f"{_ARTICLE}/Journal/JournalIssue"
#: Single values of a PubMed article by XPath.
_PUBMED = {
    "id": "//PubmedArticle[1]/MedlineCitation/PMID", "title": f"{_ARTICLE}/ArticleTitle", "year": f"{_ISSUE}/PubDate/Year", "date": f"{_ISSUE}/PubDate/MedlineDate", "journal": f"{_ARTICLE}/Journal/Title", "short": f"{_ARTICLE}/Journal/ISOAbbreviation",
    "volume": f"{_ISSUE}/Volume", "issue": f"{_ISSUE}/Issue", "first": f"{_ARTICLE}/Pagination/StartPage", "last": f"{_ARTICLE}/Pagination/EndPage", "pages": f"{_ARTICLE}/Pagination/MedlinePgn", "doi": f"{_ARTICLE}/ELocationID[@EIdType='doi']",
}
#: No XML text has it.
_BETWEEN = "\x01"


def _pubmed_values(xml: Column) -> list[Column]:
    """The article's single values in the order of _PUBMED, and its authors' last names and initials: each XPath expression reads the whole text anew, so one gives all the values."""
    path = "concat(" + f", '{_BETWEEN}', ".join(f"string({p})" for p in _PUBMED.values()) + ")"
    name = lambda part: F.xpath(xml, F.lit(f"{_ARTICLE}/AuthorList/Author/{part}/text()"))
    return [F.split(F.xpath_string(xml, F.lit(path)), _BETWEEN), name("LastName"), name("Initials")]


def _pubmed(v: Column, last: Column, initials: Column) -> list[Column]:
    at = {n: present(F.get(v, F.lit(i))) for i, n in enumerate(_PUBMED)}
    authors = F.zip_with(last, F.slice(initials, F.lit(1), F.size(last)), lambda n, i: F.when(i.isNotNull(), F.concat(n, F.lit(", "), i, F.lit("."))).otherwise(n))
    year = F.coalesce(at["year"], first_match(at["date"], r"\d{4}"))
    return _publication("pubmed", pub_id=at["id"], title=at["title"], authors=authors, publication_year=year, journal=F.coalesce(at["journal"], at["short"]), volume=at["volume"], issue=at["issue"], page_first=F.coalesce(at["first"], _pages(at["pages"], 0)), page_last=F.coalesce(at["last"], _pages(at["pages"], 1)), main_doi=clean_doi(at["doi"]), alternative_dois=F.array().cast(_NO_STRINGS))


_NORMALIZERS: dict[str, Callable[[Column], list[Column]]] = {"openalex": _openalex, "openaire": _openaire, "crossref": _crossref, "hal": _hal}


def publications(payloads: DataFrame, api: str, column: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Payload strings of a source to publications, beside the columns to keep; a payload that can't be read gives a row of nulls."""
    source(api)
    if api == "pubmed":
        well = F.col(column).rlike(r"(?s)^\s*<.*>\s*$")
        read = payloads.select(*keep, F.when(well, F.col(column)).alias("x")).select(*keep, *(c.alias(f"__{i}") for i, c in enumerate(_pubmed_values(F.col("x")))))
        return read.select(*keep, *_pubmed(*map(F.col, ("__0", "__1", "__2"))))
    parsed = payloads.select(*keep, F.from_json(F.col(column), PAYLOADS[api], {"mode": "PERMISSIVE"}).alias("p"))
    return parsed.select(*keep, *_NORMALIZERS[api](F.col("p")))


#: Where the rows of a search's response are.
RESPONSE_ROWS = {"openalex": "$.results", "openaire": "$.results", "crossref": "$.message.items", "hal": "$.response.docs"}


def response_rows(responses: DataFrame, api: str, column: str = "response", keep: Sequence[str] = ()) -> DataFrame:
    """Search responses (JSON) to one payload string per row, after the columns to keep and, if there are any, rank (from 1); a response without rows gives none."""
    rows = F.from_json(F.get_json_object(F.col(column), RESPONSE_ROWS[source(api).name]), "array<variant>")
    if not keep:
        return responses.select(F.explode(rows).alias("v")).select(F.to_json("v").alias("payload"))
    return responses.select(*keep, F.posexplode(rows).alias("k", "v")).select(*keep, (F.col("k") + 1).alias("rank"), F.to_json("v").alias("payload"))


def doi_section(main: Column, alternatives: Column) -> Column:
    """DOI: x, and after it the alternatives that differ; empty without a main one."""
    bare = without_resolver(main)
    others = F.array_compact(F.transform(F.coalesce(alternatives, F.array().cast(_NO_STRINGS)), lambda a: F.when((F.length(a) > 0) & (a != main) & (without_resolver(a) != bare), without_resolver(a))))
    more = F.when(F.size(others) > 0, F.concat(F.lit(". Alternative DOIs: "), F.array_join(others, ", "))).otherwise(F.lit(""))
    return F.when(F.length(main) > 0, F.concat(F.lit("DOI: "), bare, more)).otherwise(F.lit(""))


def author_list(authors: Column) -> Column:
    """Three authors at most, and et al. for more."""
    first = F.array_join(F.slice(authors, 1, 3), ", ")
    return F.when(F.size(authors) > 3, F.concat(first, F.lit(", et al."))).otherwise(first)


def apa_citation() -> Column:
    """The APA-like citation of a publication's columns, in its source's layout; parts that are missing are left out."""
    c = F.col
    some = lambda x, *around: F.when(F.length(x) > 0, F.concat(*(F.lit(a) if isinstance(a, str) else a for a in around)))
    authors = author_list(c("authors"))
    has = F.length(authors) > 0
    year = F.coalesce(present(c("publication_year")), F.lit("n.d."))
    title = some(c("title"), c("title"), ".")
    span = F.regexp_replace(F.concat(F.coalesce(c("page_first"), F.lit("")), F.lit("-"), F.coalesce(c("page_last"), F.lit(""))), "^-+|-+$", "")
    pages = some(span, span, ".")
    doi = F.nullif(doi_section(c("main_doi"), c("alternative_dois")), F.lit(""))
    journal, volume, issue = some(c("journal"), c("journal"), ","), present(c("volume")), some(c("issue"), "(", c("issue"), ")")
    year_part = F.concat(F.lit("("), year, F.lit(")."))
    own_pages = some(c("pages"), c("pages"), ".")
    place = F.concat_ws(": ", present(c("journal")), present(c("publisher")))
    layouts = {
        "openalex": [some(authors, authors), F.when(has, year_part).otherwise(F.lit(".")), title, journal, volume, issue, pages, doi],
        "openaire": [some(authors, authors), year_part, title, journal, volume, pages, doi],
        "pubmed": [some(authors, authors), year_part, title, journal, F.when(volume.isNotNull() | issue.isNotNull(), F.concat(F.coalesce(volume, F.lit("")), F.lit("("), F.coalesce(c("issue"), F.lit("")), F.lit(")"))), pages, doi],
        "crossref": [some(authors, authors), year_part, title, some(place, place, "."), own_pages, doi],
        "hal": [some(authors, authors), F.when(present(c("publication_year")).isNotNull(), year_part).otherwise(F.lit(".")), title, journal, volume, issue, some(c("pages"), "pp. ", c("pages"), "."), doi],
    }
    out = _none()
    for name, parts in layouts.items():
        out = F.when(c("api") == name, F.concat_ws(" ", *parts)).otherwise(out)
    return out
