"""DOIs and source identifiers. Column to Column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.text import let, present, strip

DOI = r"^10\.\d{4,}/[^\s]+$"
#: Prefixes that stand before a DOI, in the order in which they are tried.
PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:")


def without_resolver(c: Column) -> Column:
    """Without the two common resolver addresses, wherever they stand."""
    return F.replace(F.replace(c, F.lit("https://doi.org/"), F.lit("")), F.lit("http://dx.doi.org/"), F.lit(""))


def clean_doi(c: Column) -> Column:
    """A DOI without resolver address, case kept; null if it isn't one."""
    return let(strip(without_resolver(c)), lambda v: F.when(v.rlike(DOI), v))


_PREFIX = "^(?i:" + "|".join(p.replace(".", r"\.") for p in PREFIXES) + ")"


def normalize_doi(c: Column) -> Column:
    """A DOI for comparison: the first fitting prefix off, no trailing slashes, lower case."""
    bare = strip(F.regexp_replace(strip(c), _PREFIX, ""))
    return F.nullif(F.lower(F.rtrim(bare, F.lit("/"))), F.lit(""))


def comparable_doi(c: Column) -> Column:
    """A DOI as the pairwise similarity compares it: lower case, then each of four prefixes off in turn."""
    v = F.lower(strip(c))
    for p in ("https://doi.org/", "http://doi.org/", "doi:", "doi "):
        v = F.regexp_replace(v, f"^{p}", "")
    return strip(v)


def normalize_id(api: Column, c: Column) -> Column:
    """A source's identifier without its address; a CrossRef one is a DOI."""
    return let(present(strip(c)), lambda v: _core_id(api, v))


def _core_id(api: Column, v: Column) -> Column:
    last = lambda host: F.when(F.contains(v, F.lit(host)), F.element_at(F.split(v, host.replace(".", r"\.")), -1)).otherwise(v)
    return F.when(api == "openalex", last("openalex.org/")).when(api == "pubmed", last("pubmed.ncbi.nlm.nih.gov/")).when(api == "crossref", normalize_doi(v)).when(api == "hal", last("hal.science/")).otherwise(v)


#: Address of a publication by source; {} is the identifier.
URI_TEMPLATES: Mapping[str, str] = {
    "openalex": "https://openalex.org/{}",
    "openaire": "https://explore.openaire.eu/search/publication?pid={}",
    "pubmed": "https://pubmed.ncbi.nlm.nih.gov/{}",
    "crossref": "https://doi.org/{}",
    "hal": "https://hal.science/{}",
}


def publication_uri(api: Column, pub_id: Column, doi: Column) -> Column:
    """Where a publication is found: CrossRef by DOI, OpenAIRE by DOI if it has one. Null without identifier."""
    out = F.lit(None).cast("string")
    for name, template in URI_TEMPLATES.items():
        own = F.when(pub_id.isNotNull(), F.coalesce(doi, pub_id)) if name == "openaire" else doi if name == "crossref" else pub_id
        head, tail = template.split("{}")
        out = F.when(api == name, F.concat(F.lit(head), own, F.lit(tail))).otherwise(out)
    return out


def doi_match(main: Column, alternatives: Column, expected: Column) -> Column:
    """EXACT, INCORRECT or N/A: an expected DOI against a main one and its alternatives."""
    return let(clean_doi(expected), lambda want: _doi_match(main, alternatives, want))


def _doi_match(main: Column, alternatives: Column, want: Column) -> Column:
    hit = F.coalesce(clean_doi(main) == want, F.lit(False)) | F.coalesce(F.exists(alternatives, lambda a: clean_doi(a) == want), F.lit(False))
    some = F.coalesce(F.length(main) > 0, F.lit(False)) | (F.coalesce(F.size(alternatives), F.lit(0)) > 0)
    return F.when(want.isNull(), "N/A").when(hit, "EXACT").when(some, "INCORRECT").otherwise("N/A")


def all_dois(main: Column, alternatives: Column) -> Column:
    """Main DOI and alternatives as one array without nulls."""
    return F.array_compact(F.concat(F.array(F.nullif(main, F.lit(""))), F.coalesce(alternatives, F.array().cast("array<string>"))))
