"""Journal names to the identifiers of a catalog of sources, with abbreviations expanded by a list of serials.

Every distinct name is resolved once: first among the catalog's names, then, for what is left, by the serial whose
abbreviation or title fits best, whose full title is looked for in the catalog. A name without result is a row with a
null identifier, so that a table of known names answers for it too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.journal import names_score, normalize_journal
from refloom.functions.text import strip
from refloom.sources.storage import settled

#: A serial's similarity must be above this; a full title's counts less than an abbreviation's.
LEAST, TITLE_SHARE = 0.6, 0.8


def _words(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "), " "), lambda w: w != "")))


def first_hits(names: DataFrame, sources: DataFrame) -> DataFrame:
    """(name) to (name, source_id): the first source, by rank, whose display_name has all words of the name. Names under 3 characters have none.

    sources: source_id, display_name, rank. The join is on a name's rarest word, which few sources have.
    """
    index = sources.select("source_id", "rank", _words(F.col("display_name")).alias("has"))
    index = settled(index)
    postings = index.select("source_id", "rank", "has", F.explode("has").alias("word"))
    df = postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    asked = names.where(F.length(strip(F.col("name"))) >= 3).select("name", _words(F.col("name")).alias("wants")).where(F.size("wants") > 0)
    by = asked.select("name", "wants", F.explode("wants").alias("word")).join(df, "word").groupBy("name", "wants").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("df", "word")).alias("least"))
    keyed = by.where(F.col("n") == F.size("wants")).select("name", "wants", F.col("least.word").alias("word"))
    met = keyed.join(postings, "word").where(F.size(F.array_except("wants", "has")) == 0)
    return met.groupBy("name").agg(F.min(F.struct("rank", "source_id")).alias("first")).select("name", "first.source_id")


def _initials(c: Column) -> Column:
    return F.array_join(F.transform(F.split(normalize_journal(c), " "), lambda w: F.substr(w, F.lit(1), F.lit(1))), "")


def best_serials(names: DataFrame, serials: DataFrame) -> DataFrame:
    """(name) to (name, title): the serial whose abbreviation, or title at TITLE_SHARE, is most like the name, if above LEAST; the first in the list of equals.

    serials: no, title, abbreviation (see journal.catalog_entries). Compared are serials whose abbreviation or title has
    the name's initials, or shares its first word; equal pairs of normal forms once.
    """
    forms = serials.select("no", "title", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(1.0).alias("share"), F.col("abbreviation").alias("form")), F.struct(F.lit(1).alias("k"), F.lit(TITLE_SHARE).alias("share"), F.col("title").alias("form")))).alias("f")).select("no", "title", "f.*")
    keys = lambda own, raw: F.array_distinct(F.array_compact(F.array(F.concat(F.lit("i|"), _initials(raw)), F.concat(F.lit("w|"), F.substring_index(own, " ", 1)))))
    forms = forms.withColumn("own", normalize_journal(F.col("form"))).where("own is not null")
    forms = forms.withColumn("key", F.explode(keys(F.col("own"), F.col("form"))))
    asked = names.withColumn("wants", normalize_journal(F.col("name"))).where("wants is not null")
    asked = asked.withColumn("key", F.explode(keys(F.col("wants"), F.col("name"))))
    pairs = asked.join(forms, "key").select("name", "wants", "no", "k", "share", "title", "own").distinct()
    scored = pairs.withColumn("score", F.col("share") * names_score(F.col("wants"), F.col("own"))).where(F.col("score") > LEAST)
    best = Window.partitionBy("name").orderBy(F.desc("score"), "no", "k")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("name", "title")


def resolve_journals(names: DataFrame, sources: DataFrame, serials: DataFrame | None = None, known: DataFrame | None = None, fallback: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(name) to one row per distinct name: name, source_id (null if there is none), how (direct, serial, fallback or null).

    known: rows of an earlier call, which are taken as they are, nulls too. fallback: from the names (name) that are
    left to (name, title) by some other means, as a search of the web; the titles are looked for in the catalog.
    """
    asked = names.where("name is not null").select("name").distinct()
    kept = None
    if known is not None:
        kept = known.select("name", "source_id", "how").join(asked, "name", "left_semi")
        asked = asked.join(known.select("name"), "name", "left_anti")
    asked = settled(asked)
    out = first_hits(asked, sources).withColumn("how", F.lit("direct"))
    steps = ([("serial", lambda left: best_serials(left, serials))] if serials is not None else []) + ([("fallback", fallback)] if fallback is not None else [])
    for how, expand in steps:
        out = settled(out)
        titles = expand(asked.join(out, "name", "left_anti")).where(F.lower("title") != F.lower("name"))
        # a leading article is left out in some catalogs
        both = titles.select(F.col("name").alias("asked"), F.posexplode(F.array_distinct(F.array(F.lower("title"), F.regexp_replace(F.lower("title"), "^the ", "")))).alias("k", "name"))
        hits = first_hits(both.select("name").distinct(), sources)
        found = both.join(hits, "name").groupBy("asked").agg(F.min(F.struct("k", "source_id")).alias("first")).select(F.col("asked").alias("name"), "first.source_id", F.lit(how).alias("how"))
        out = out.unionByName(found)
    whole = asked.join(out, "name", "left").select("name", "source_id", "how")
    return whole if kept is None else whole.unionByName(kept)


def with_journal_ids(citations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Adds journal_id to citations (with e.journal), by the rows of resolve_journals."""
    of = resolved.select(F.col("name").alias("__name"), F.col("source_id").alias("journal_id"))
    return citations.join(of, F.col("e.journal") == F.col("__name"), "left").drop("__name")
