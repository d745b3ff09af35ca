"""What each bibliographic source can search by, in which order, and at what pace."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class SearchField:
    """A field's parameter at a source, how it matches, and the name of what is done to its value first."""

    parameter: str
    match: str
    prepare: str | None = None


@dataclass(frozen=True)
class Pace:
    """Retries and pauses for remote use, in seconds."""

    retries: int
    base_delay: float
    pause: float
    timeout: float
    longest_delay: float = 30.0

    def delay(self, attempt: int) -> float:
        """Exponential back-off before the attempt after this one (from 0)."""
        return min(self.base_delay * 2**attempt, self.longest_delay)


@dataclass(frozen=True)
class SourceSpec:
    name: str
    fields: Mapping[str, SearchField]
    tiers: Sequence[Sequence[str]]
    pace: Pace
    several_dois: bool = False
    base_url: str = ""


def _tiers(text: str) -> list[tuple[str, ...]]:
    return [tuple(line.split()) for line in text.strip().splitlines()]


# Search fields, tiers from restrictive to broad, and paces of the five sources.

OPENALEX = SourceSpec(
    "openalex",
    {
        "DOI": SearchField("doi", "exact", "clean_doi"),
        "TITLE": SearchField("title.search", "search", "clean_title"),
        "AUTHORS": SearchField("raw_author_name.search", "search", "surname_query"),
        "PUBLICATION_YEAR": SearchField("publication_year", "exact"),
        "JOURNAL": SearchField("locations.source.id", "exact", "journal_id"),
        "VOLUME": SearchField("biblio.volume", "exact"),
        "ISSUE": SearchField("biblio.issue", "exact"),
        "PAGE_FIRST": SearchField("biblio.first_page", "exact"),
        "PAGE_LAST": SearchField("biblio.last_page", "exact"),
        "TITLE_SEGMENTED": SearchField("title.search", "search", "segment_title"),
    },
    _tiers("""
        DOI
        TITLE PUBLICATION_YEAR AUTHORS JOURNAL
        TITLE PUBLICATION_YEAR AUTHORS
        TITLE PUBLICATION_YEAR JOURNAL
        TITLE PUBLICATION_YEAR
        TITLE AUTHORS
        TITLE
        TITLE_SEGMENTED PUBLICATION_YEAR AUTHORS JOURNAL
        TITLE_SEGMENTED PUBLICATION_YEAR AUTHORS
        TITLE_SEGMENTED PUBLICATION_YEAR JOURNAL
        TITLE_SEGMENTED PUBLICATION_YEAR
        TITLE_SEGMENTED AUTHORS
        TITLE_SEGMENTED
        AUTHORS JOURNAL VOLUME ISSUE PAGE_FIRST PUBLICATION_YEAR
        JOURNAL VOLUME ISSUE PAGE_FIRST PUBLICATION_YEAR
        AUTHORS JOURNAL VOLUME PAGE_FIRST PUBLICATION_YEAR
        JOURNAL VOLUME PAGE_FIRST PUBLICATION_YEAR
        AUTHORS PUBLICATION_YEAR JOURNAL VOLUME PAGE_FIRST
        AUTHORS PUBLICATION_YEAR JOURNAL VOLUME
        AUTHORS PUBLICATION_YEAR JOURNAL ISSUE PAGE_FIRST
        AUTHORS PUBLICATION_YEAR JOURNAL
        JOURNAL PUBLICATION_YEAR VOLUME ISSUE PAGE_FIRST
        JOURNAL PUBLICATION_YEAR VOLUME ISSUE
        JOURNAL PUBLICATION_YEAR VOLUME
        AUTHORS PUBLICATION_YEAR
        JOURNAL PUBLICATION_YEAR
        AUTHORS JOURNAL
    """),
    Pace(3, 1.0, 0.5, 20),
    base_url="https://api.openalex.org/works",
)

PUBMED = SourceSpec(
    "pubmed",
    {
        "DOI": SearchField("doi", "exact", "clean_doi"),
        "TITLE": SearchField("title", "search"),
        "AUTHORS": SearchField("author", "search", "surname"),
        "PUBLICATION_YEAR": SearchField("pdat", "exact"),
        "JOURNAL": SearchField("journal", "search"),
        "VOLUME": SearchField("volume", "exact"),
        "ISSUE": SearchField("issue", "exact"),
        "PAGE_FIRST": SearchField("first_page", "exact"),
        "PAGE_LAST": SearchField("last_page", "exact"),
    },
    _tiers("""
        DOI
        TITLE AUTHORS JOURNAL PUBLICATION_YEAR
        TITLE JOURNAL PUBLICATION_YEAR
        TITLE AUTHORS PUBLICATION_YEAR
        TITLE PUBLICATION_YEAR
        TITLE AUTHORS
        TITLE
        AUTHORS JOURNAL VOLUME ISSUE PAGE_FIRST PUBLICATION_YEAR
        JOURNAL VOLUME ISSUE PAGE_FIRST PUBLICATION_YEAR
        AUTHORS JOURNAL VOLUME PAGE_FIRST PUBLICATION_YEAR
        JOURNAL VOLUME PAGE_FIRST PUBLICATION_YEAR
        AUTHORS JOURNAL PUBLICATION_YEAR VOLUME
        AUTHORS JOURNAL PUBLICATION_YEAR PAGE_FIRST
        AUTHORS JOURNAL PUBLICATION_YEAR
        JOURNAL PUBLICATION_YEAR VOLUME ISSUE
        JOURNAL PUBLICATION_YEAR VOLUME
        JOURNAL PUBLICATION_YEAR PAGE_FIRST
        AUTHORS PUBLICATION_YEAR
        JOURNAL PUBLICATION_YEAR
    """),
    Pace(5, 2.0, 1.2, 60),
    base_url="https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi",
)

OPENAIRE = SourceSpec(
    "openaire",
    {
        "DOI": SearchField("pid", "exact", "clean_doi"),
        "TITLE": SearchField("mainTitle", "search"),
        "AUTHORS": SearchField("authorFullName", "search", "surname_query"),
        "PUBLICATION_YEAR": SearchField("fromPublicationDate", "range", "year_range"),
        "TITLE_SEGMENTED": SearchField("mainTitle", "search", "segment_title"),
    },
    _tiers("""
        DOI
        TITLE AUTHORS PUBLICATION_YEAR
        TITLE PUBLICATION_YEAR
        TITLE AUTHORS
        TITLE
        TITLE_SEGMENTED AUTHORS PUBLICATION_YEAR
        TITLE_SEGMENTED PUBLICATION_YEAR
        TITLE_SEGMENTED AUTHORS
        TITLE_SEGMENTED
        AUTHORS PUBLICATION_YEAR
    """),
    Pace(5, 2.0, 1.0, 45),
    several_dois=True,
    base_url="https://api.openaire.eu/graph/v1/researchProducts",
)

CROSSREF = SourceSpec(
    "crossref",
    {
        "DOI": SearchField("query", "search", "clean_doi"),
        "TITLE": SearchField("query.title", "search"),
        "AUTHORS": SearchField("query.author", "search", "surname"),
        "PUBLICATION_YEAR": SearchField("filter", "filter", "year_filter"),
        "JOURNAL": SearchField("query.container-title", "search"),
    },
    _tiers("""
        DOI
        TITLE AUTHORS PUBLICATION_YEAR
        TITLE PUBLICATION_YEAR
        TITLE AUTHORS
        TITLE
        AUTHORS PUBLICATION_YEAR
        JOURNAL PUBLICATION_YEAR
    """),
    Pace(5, 2.0, 1.0, 45),
    base_url="https://api.crossref.org/works",
)

HAL = SourceSpec(
    "hal",
    {
        "DOI": SearchField("doiId_s", "exact", "clean_doi"),
        "TITLE": SearchField("title_t", "search"),
        "AUTHORS": SearchField("authFullName_t", "search", "surname"),
        "PUBLICATION_YEAR": SearchField("publicationDateY_s", "exact"),
        "JOURNAL": SearchField("journalTitle_t", "search"),
        "VOLUME": SearchField("volume_s", "exact"),
        "ISSUE": SearchField("issue_s", "exact"),
        "PAGE_FIRST": SearchField("page_s", "search"),
        "PAGE_LAST": SearchField("page_s", "search"),
    },
    _tiers("""
        DOI
        TITLE AUTHORS PUBLICATION_YEAR JOURNAL
        TITLE AUTHORS PUBLICATION_YEAR
        TITLE PUBLICATION_YEAR JOURNAL
        TITLE PUBLICATION_YEAR
        TITLE AUTHORS
        TITLE
        AUTHORS JOURNAL VOLUME ISSUE PAGE_FIRST PUBLICATION_YEAR
        JOURNAL VOLUME ISSUE PAGE_FIRST PUBLICATION_YEAR
        AUTHORS JOURNAL VOLUME PAGE_FIRST PUBLICATION_YEAR
        JOURNAL VOLUME PAGE_FIRST PUBLICATION_YEAR
        AUTHORS JOURNAL PUBLICATION_YEAR VOLUME
        AUTHORS JOURNAL PUBLICATION_YEAR PAGE_FIRST
        AUTHORS JOURNAL PUBLICATION_YEAR
        JOURNAL PUBLICATION_YEAR VOLUME ISSUE PAGE_FIRST
        JOURNAL PUBLICATION_YEAR VOLUME ISSUE
        JOURNAL PUBLICATION_YEAR VOLUME
        AUTHORS PUBLICATION_YEAR
        JOURNAL PUBLICATION_YEAR
    """),
    Pace(3, 1.5, 0.7, 25),
    base_url="https://api.archives-ouvertes.fr/search/",
)

# End of fixed values.

#: All sources, in the order in which they vote.
SOURCES: dict[str, SourceSpec] = {s.name: s for s in (OPENALEX, OPENAIRE, PUBMED, CROSSREF, HAL)}


def source(name: str) -> SourceSpec:
    """A registered source; ValueError for an unknown name."""
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(SOURCES)}")
    return SOURCES[name]


def register(spec: SourceSpec) -> None:
    """Adds a source, after the others; it takes part in ensembles that name it."""
    SOURCES[spec.name] = spec


@dataclass(frozen=True)
class Limits:
    """Candidates wanted in all, and rows taken per tier."""

    target: int = 10
    per_page: int = 5
    per_page_broad: int = 10


def capability_summary(spark) -> DataFrame:
    """What each source can be asked for, a row each: source, fields, tiers, several_dois, pause, retries, timeout, address."""
    rows = [(s.name, list(s.fields), len(s.tiers), s.several_dois, float(s.pace.pause), s.pace.retries, float(s.pace.timeout), s.base_url) for s in SOURCES.values()]
    return spark.createDataFrame(rows, "source string, fields array<string>, tiers int, several_dois boolean, pause double, retries int, timeout double, address string")
