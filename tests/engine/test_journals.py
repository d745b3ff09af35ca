"""Journal names to identifiers, against loops."""

import random

from refloom.functions.journal import name_score
from refloom.operators import journals

SOURCES = [("S1", "Journal of Neuroscience", 1), ("S2", "The Journal of Clinical Medicine", 2), ("S3", "Neuroscience Letters", 3), ("S4", "Nature", 4), ("S5", "Nature Physics", 0), ("S6", "Annals of Botany", 6)]
SERIALS = [(1, "Journal of clinical medicine", "J Clin Med"), (2, "The Journal of neuroscience", "J Neurosci"), (3, "Nature", "Nature"), (4, "Annals of botany", "Ann Bot"), (5, "Annals of Bother", None)]


def frames(spark):
    return spark.createDataFrame(SOURCES, "source_id string, display_name string, rank int"), spark.createDataFrame(SERIALS, "no int, title string, abbreviation string")


def test_resolving_names(spark):
    sources, serials = frames(spark)
    names = ["Journal of Neuroscience", "nature", "J. Neurosci.", "J Clin Med", "Ann. Bot.", "Ab", "Unknown Gazette", "", None, "nature"]
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.source_id, r.how) for r in journals.resolve_journals(asked, sources, serials).collect()}
    # of the names with the word nature, the first by rank is the physics journal
    assert got == {"Journal of Neuroscience": ("S1", "direct"), "nature": ("S5", "direct"), "J. Neurosci.": ("S1", "serial"), "J Clin Med": ("S2", "serial"), "Ann. Bot.": ("S6", "serial"), "Ab": (None, None), "Unknown Gazette": (None, None), "": (None, None)}
    known = spark.createDataFrame([("J Clin Med", None, None), ("Nature", "S9", "direct")], "name string, source_id string, how string")
    again = {r.name: r.source_id for r in journals.resolve_journals(asked, sources, serials, known).collect()}
    assert again["J Clin Med"] is None and again["J. Neurosci."] == "S1" and "Nature" not in again and len(again) == 8
    web = lambda left: left.where("name = 'Unknown Gazette'").selectExpr("name", "'The Annals of Botany' AS title")
    last = {r.name: (r.source_id, r.how) for r in journals.resolve_journals(asked, sources, serials, fallback=web).collect()}
    assert last["Unknown Gazette"] == ("S6", "fallback")
    assert journals.resolve_journals(asked.limit(0), sources, serials).count() == 0


def test_best_serials_against_a_loop(spark):
    from refloom.functions.journal import normalize_journal

    r = random.Random(6)
    words = ["journal", "annals", "clinical", "medicine", "botany", "physics", "letters", "applied", "research"]
    serials = [(i, " ".join(r.sample(words, r.randint(1, 4))).title(), None if r.random() < 0.3 else ". ".join(w[: r.randint(1, 5)] for w in r.sample(words, r.randint(1, 3)))) for i in range(40)]
    names = sorted({" ".join(w[: r.randint(1, 9)] for w in r.sample(words, r.randint(1, 4))) for _ in range(40)})
    table = spark.createDataFrame(serials, "no int, title string, abbreviation string")
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    got = {x.name: x.title for x in journals.best_serials(asked, table).collect()}
    forms = {x.s: x.n for x in spark.createDataFrame([(s,) for s in {t for x in serials for t in x[1:] if t} | set(names)], "s string").select("s", normalize_journal("s").alias("n")).collect()}
    initials = lambda s: "".join(w[0] for w in forms[s].split(" "))
    for n in names:
        best, title = 0.6, None
        for _, full, short in serials:
            for form, share in ((short, 1.0), (full, 0.8)):
                if form and forms[n] and forms[form] and (initials(n) == initials(form) or forms[n].split()[0] == forms[form].split()[0]):
                    s = share * name_score(forms[n], forms[form])
                    if s > best:
                        best, title = s, full
        assert got.get(n) == title, n
    assert len(got) > 5
