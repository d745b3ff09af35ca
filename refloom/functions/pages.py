"""Years, volumes, pages, and the patterns of formatted citations. Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.text import first_match, let, strip

#: Years taken for publication years.
FIRST_YEAR, LAST_YEAR = 1800, 2050


def any_year(c: Column) -> Column:
    """The first number from 1900 to 2099 that stands alone, as an int."""
    return first_match(c, r"\b(19|20)\d{2}\b").try_cast("int")


def _valid_year(c: Column) -> Column:
    return F.coalesce(strip(c).try_cast("int").between(FIRST_YEAR, LAST_YEAR), F.lit(False)) & strip(c).rlike(r"^[+-]?\d+$")


def year_range(c: Column) -> Column:
    """First and last day of a year as strings, or null."""
    return F.when(_valid_year(c), F.struct(F.concat(c, F.lit("-01-01")).alias("from_date"), F.concat(c, F.lit("-12-31")).alias("to_date")))


def year_filter(c: Column) -> Column:
    """A year as a filter of publication dates, or null."""
    return F.when(_valid_year(c), F.concat(F.lit("from-pub-date:"), c, F.lit("-01-01,until-pub-date:"), c, F.lit("-12-31")))


def first_digits(c: Column) -> Column:
    """The first run of digits, as a string."""
    return first_match(c, r"\d+")


def page_key(c: Column) -> Column:
    """Kind and value of a page: an electronic one (e and digits) or the first number."""
    kinds = F.array(F.struct(F.lit("electronic").alias("kind"), F.lower(first_match(c, r"(?i)\be\d+\b")).alias("value")), F.struct(F.lit("numeric").alias("kind"), first_digits(c).alias("value")))
    return F.get(F.filter(kinds, lambda k: k["value"].isNotNull()), F.lit(0))


def full_last_page(first: Column, last: Column) -> Column:
    """The last page, with the leading digits of the first put before it where it is cut short and that makes a later page."""
    return let(F.struct(first_digits(first).alias("a"), first_digits(last).alias("b"), last.alias("last")), _grown)


def _grown(x: Column) -> Column:
    a, b, last = x["a"], x["b"], x["last"]
    na, nb = F.length(a), F.length(b)
    grown = F.concat(F.substr(a, F.lit(1), na - nb), b)
    ok = (nb < na) & (b.try_cast("decimal(38,0)") <= a.try_cast("decimal(38,0)")) & (grown.try_cast("decimal(38,0)") > a.try_cast("decimal(38,0)"))
    return F.when(F.coalesce(ok, F.lit(False)), grown).otherwise(last)


#: Where a formatted citation has its numbers.
PATTERNS = {
    "volume_issue_pages": r"(\d+)\s*\((\d+)\)\s*(\d+)-(\d+)",
    "volume_issue": r"(\d+)\s*\((\d+)\)",
    "volume_only": r",\s*(\d+)\s*(?:\(|$)",
    "year": r"\((\d{4})\)",
    "doi": r"DOI:\s*(10\.\d+/[^\s]+)",
    "pages_only": r"(\d+)-(\d+)\.",
    "electronic_pages": r"(e\d+)",
}


def citation_patterns(c: Column) -> Column:
    """A struct of what the patterns find: volume, issue, page_first, page_last, publication_year, doi; the fullest pattern first."""
    full = lambda g: first_match(c, PATTERNS["volume_issue_pages"], g)
    has_full = full(1).isNotNull()
    volume = F.coalesce(full(1), first_match(c, PATTERNS["volume_issue"], 1), first_match(c, PATTERNS["volume_only"], 1))
    issue = F.coalesce(full(2), first_match(c, PATTERNS["volume_issue"], 2))
    page_first = F.coalesce(full(3), first_match(c, PATTERNS["pages_only"], 1), first_match(c, PATTERNS["electronic_pages"], 1))
    page_last = F.when(has_full, full(4)).otherwise(first_match(c, PATTERNS["pages_only"], 2))
    return F.struct(volume.alias("volume"), issue.alias("issue"), page_first.alias("page_first"), page_last.alias("page_last"), first_match(c, PATTERNS["year"], 1).alias("publication_year"), first_match(c, PATTERNS["doi"], 1).alias("doi"))
