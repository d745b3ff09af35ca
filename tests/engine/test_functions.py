"""Scalar functions, each with inputs and what is expected of them."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from refloom.functions import authors, doi, entities, journal, pages, similarity, text
from refloom.sources.requests import params_key, params_of, query_parts, request_url
from refloom.sources.spec import SOURCES, Pace, source

CASES = {
    text.clean_title: [('"Deep  nets".', "Deep nets"), ("a ", None), (None, None), ("Of mice -;", "Of mice")],
    text.segment_title: [("one two three", "one two three"), ("one two three four five", "one two|three four five"), ("x", None)],
    text.clean_filter_value: [("A (b) c: d/e, 'f' — g?", "A c d e f - g"), ("ab", None)],
    text.encode_path: [("a b/c&é", "a%20b/c%26%C3%A9")],
    text.encode_form: [("a b/c", "a+b%2Fc")],
    text.join_subwords: [("jsr . ##12 ##847", "jsr.12847"), ("a - b : c", "a-b:c")],
    text.drop_debris: [(".,x y ;", "x y")],
    doi.clean_doi: [("https://doi.org/10.1000/Ab", "10.1000/Ab"), ("10.12/x", None), ("doi:10.1000/a", None), ("http://dx.doi.org/10.1000/a b", None)],
    doi.normalize_doi: [("DOI:10.1/A//", "10.1/a"), ("https://dx.doi.org/10.1/b ", "10.1/b"), (" ", None), (None, None)],
    doi.comparable_doi: [("https://doi.org/doi:10.1/A", "10.1/a"), ("DOI 10.1/a", "10.1/a")],
    authors.surname: [("Smith, J.", "Smith"), ("J. Smith et al.", "Smith"), ("Smith J", "Smith"), ("Jane Mary Smith", "Smith"), ("A.B.Smith", "Smith"), ("Smith J, Jones K", "Smith"), ("Li; Wu", None), ("Miller; Wu", "Miller"), ("et al.", None), ("", None), ("John Smith (MIT)", "John")],
    authors.surname_query: [("Smith, J. ; Jones, K.", "((Smith AND Jones) OR Smith OR Jones)"), ("Smith, J. ; ", "Smith"), ("Smith, J.", "Smith")],
    authors.normalize_author: [("Müller et al.", "muller"), ("Ardito, C.", "ardito"), ("", "")],
    pages.any_year: [("in 2019a or 1999", 1999), ("20190", None), ("éx 2001.", 2001)],
    pages.year_filter: [("2001", "from-pub-date:2001-01-01,until-pub-date:2001-12-31"), ("1700", None), ("x", None)],
    journal.normalize_journal: [("The J. of Immunol.: A/B", "j immunol a b"), ("of", None)],
    journal.core_journal: [("International Journal of Sleep-Research", "sleep research")],
}


@pytest.mark.parametrize("function", CASES, ids=lambda f: f.__name__)
def test_cases(spark, function):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES[function])], "i int, a string")
    got = [r.x for r in rows.select("i", function(F.col("a")).alias("x")).orderBy("i").collect()]
    assert got == [want for _, want in CASES[function]]


@pytest.mark.parametrize("first, last, want", [("4307", "12", "4312"), ("4307", "92", "4392"), ("4307", "123", "123"), ("1999", "03", "03"), ("139", "53", "153"), ("10", "12", "12"), (None, "3", "3")])
def test_page_ranges(spark, first, last, want):
    row = spark.createDataFrame([(first, last)], "a string, b string").select(pages.full_last_page(F.col("a"), F.col("b")).alias("x")).first()
    assert row.x == want


def test_best_entities(spark):
    raw = {"DOI": ["##12", "see 10 . 1000 / ab", "10.1000/cd"], "TITLE": ["short", "A much 'longer' title .", "A title here"], "AUTHORS": ["Al", "Smith JB, Jones K", "A much longer list of names here"], "PUBLICATION_YEAR": ["n.d.", "c2014b", "1999"], "VOLUME": ["vol", "v. 12(3)"], "PAGE_FIRST": ["12", "e345"], "PAGE_LAST": ["5"], "X": [" "]}
    row = spark.createDataFrame([(raw,)], "m map<string,array<string>>").select(entities.best_entities(F.col("m")).alias("e")).first().e
    assert row.asDict() == {"doi": "10.1000/cd", "title": "A much longer title", "authors": "Smith JB, Jones K", "journal": None, "publication_year": "2014", "volume": "12", "issue": None, "page_first": "e345", "page_last": "5"}


def test_similarities(spark):
    cases = [("2019", "2020", similarity.year_similarity, 0.7), ("2019", "2025", similarity.year_similarity, 0.0), ("p. e12", "E12", similarity.page_similarity, 1.0), ("12", "e12", similarity.page_similarity, 0.0), ("vol 07", "7", similarity.number_similarity, 0.0), ("DOI:10.1/A", "https://doi.org/10.1/a", similarity.doi_similarity, 1.0), (None, None, similarity.doi_similarity, 0.0), ("J Sleep Res", "Journal of Sleep Research", similarity.journal_similarity, 0.7 * SequenceMatcher(None, "j sleep res", "sleep research").ratio()), ("Sleep Res", "Journal of Sleep Research", similarity.journal_similarity, 0.95), ("Nature", "nature", similarity.journal_similarity, 1.0), ("Smith, John", "John Smith", similarity.author_similarity, 0.8), ("A b", "a  B!", similarity.fuzzy, 1.0), ("abcd", "bcde", similarity.fuzzy, 0.75)]
    for a, b, f, want in cases:
        row = spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("x")).first()
        assert row.x == pytest.approx(want), (a, b, f)


def test_journal_words():
    assert journal.word_score("medical", "medicine") == 0.95 and journal.word_score("med", "medicine") == 0.90 and journal.word_score("syst", "systematic") >= 0.85
    assert journal.word_score("abc", "xyz") == 0.0 and journal.name_score("jama", "journal american medical association") == 0.95
    assert journal.name_score("j clin med", "journal clinical medicine") > 0.85 > journal.name_score("physics letters", "journal botany")


def test_request_parameters_and_addresses(spark):
    row = [("10.1000/a", "A title: of (some) words", "Smith, J.", "J. Tests", "2001", "3", None, "7", None)]
    e = F.struct(*"doi title authors journal publication_year volume issue page_first page_last".split())
    base = spark.createDataFrame(row, "doi string, title string, authors string, journal string, publication_year string, volume string, issue string, page_first string, page_last string").select(e.alias("e"))
    want = {
        "openalex": 'https://api.openalex.org/works?per-page=5&filter=title.search:"A%20title%20of%20words",raw_author_name.search:Smith,publication_year:2001',
        "openaire": "https://api.openaire.eu/graph/v1/researchProducts?mainTitle=A+title%3A+of+%28some%29+words&authorFullName=Smith&fromPublicationDate=2001-01-01&toPublicationDate=2001-12-31&pageSize=5",
        "crossref": "https://api.crossref.org/works?query.title=A+title%3A+of+%28some%29+words&query.author=Smith&filter=from-pub-date%3A2001-01-01%2Cuntil-pub-date%3A2001-12-31&rows=5",
    }
    fields = F.array(*map(F.lit, ("TITLE", "AUTHORS", "PUBLICATION_YEAR")))
    for api, url in want.items():
        got = base.select(request_url(api, params_of(query_parts(source(api), F.col("e")), fields), F.lit(5)).alias("u")).first().u
        assert got == url
    key = base.select(params_key(params_of(query_parts(source("hal"), F.col("e")), F.array(F.lit("DOI"), F.lit("VOLUME"), F.lit("ISSUE")))).alias("k")).first().k
    assert key == "doiId_s=10.1000/a&volume_s=3"


def test_specs():
    assert {k: len(s.tiers) for k, s in SOURCES.items()} == {"openalex": 27, "openaire": 10, "pubmed": 19, "crossref": 7, "hal": 19}
    assert [Pace(3, 2.0, 1, 1).delay(i) for i in (0, 2, 9)] == [2.0, 8.0, 30.0]
    with pytest.raises(ValueError):
        source("nowhere")


def test_functions_of_sql(spark):
    from refloom.functions.register import register

    register(spark)
    row = spark.sql("SELECT string_ratio('abcd', 'bcde') AS r, string_ratio('x', NULL) AS n, journal_name_score('j clin med', 'journal clinical medicine') AS s").first()
    assert row.r == 0.75 and row.n is None and row.s == journal.name_score("j clin med", "journal clinical medicine")
