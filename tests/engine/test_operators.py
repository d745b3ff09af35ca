"""Operators over small tables, held against loops of our own."""

import random

import pytest
from pyspark.sql import functions as F

from refloom.operators import cache, dedup, evaluate, rank, retrieve, spans
from refloom.operators.backends import ModelBackend, RuleBackend
from refloom.plans.engine import Engine, parse_text
from refloom.sources.payloads import PUBLICATION, apa_citation, publications, response_rows
from refloom.sources.spec import source

KIND = "struct<pos: int, pub_id: string, dois: array<string>>"


def test_greedy_dedup_against_a_loop(spark):
    r = random.Random(4)
    cases = [[(i, r.choice(["a", "b", "", None]), r.sample("pqrst", r.randint(0, 2))) for i in range(r.randint(0, 8))] for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(cases)), f"k int, xs array<{KIND}>")
    got = {x.k: [y.pos for y in x.kept] for x in rows.select("k", dedup.greedy_unique(F.col("xs"), KIND).alias("kept")).collect()}
    for k, case in enumerate(cases):
        dois, ids, kept = set(), set(), []
        for pos, pub, own in case:
            if own:
                if dois & set(own):
                    continue
                dois |= set(own)
            elif pub:
                if pub in ids:
                    continue
                ids.add(pub)
            kept.append(pos)
        assert got[k] == kept


DECISIONS = [
    ([(True, 0.95, 0.1)], 0, 0.95), ([(True, 0.5, 0.7)], 0, 0.7), ([(True, 0.5, 0.2)], None, None), ([(False, 0.99, 0.1)], 0, 0.99),
    ([(False, 0.9, 0.9), (False, 0.9, 0.9)], None, None), ([(True, 0.91, 0.1), (False, 0.99, 0.9)], 0, 0.91), ([(True, 0.95, 0.2), (True, 0.99, 0.1)], 1, 0.99),
    ([(True, 0.985, 0.9), (True, 0.99, 0.1)], 0, 0.985), ([(True, 0.99, 0.5), (True, 0.99, 0.5)], 0, 0.99), ([(True, 0.6, 0.61), (True, 0.7, 0.9), (False, 0.9, 1.0)], 1, 0.9),
    ([(True, 0.6, 0.1), (False, 0.9, 0.8)], 1, 0.8), ([(True, 0.6, 0.1), (False, 0.9, 0.3)], None, None),
]


def test_decisions(spark):
    rows = [(k, pos, *x) for k, (case, _, _) in enumerate(DECISIONS) for pos, x in enumerate(case)]
    table = spark.createDataFrame(rows, "citation_id int, pos int, sel_label boolean, sel_score double, similarity double")
    got = {r.citation_id: (r.pos, r.score) for r in rank.decide(table).collect()}
    assert got == {k: (pos, score) for k, (_, pos, score) in enumerate(DECISIONS)}
    assert {r.citation_id: r.pos for r in rank.decide(table, single_candidate="strict").collect()}[3] is None


def test_sequential_stop_against_a_loop(spark):
    r = random.Random(8)
    spec = source("openalex")
    names = ["doi", "title", "authors", "journal", "publication_year", "volume", "issue", "page_first", "page_last"]
    values = {"doi": "10.1000/a", "title": "A fine title of words", "authors": "Smith, J.", "journal": "J Tests", "publication_year": "2001", "volume": "1", "issue": "2", "page_first": "3", "page_last": "4"}
    rows = [(k, {n: v if r.random() < 0.6 else None for n, v in values.items()}, {t: r.choice([0, 0, 1, 2, 5, 10]) for t in range(27)}) for k in range(60)]
    schema = "citation_id int, e struct<" + ", ".join(f"{n}: string" for n in names) + ">, counts map<int,int>"
    table = retrieve.expand_tiers(spark.createDataFrame([(k, tuple(e[n] for n in names), c) for k, e, c in rows], schema), spec)
    got = {x.citation_id: (x.last, [(t.tier, t.run) for t in x.tiers]) for x in table.withColumn("last", retrieve.run_tiers(F.col("tiers"), F.col("counts"), F.col("e"), 27, 10)["last"]).collect()}
    for k, e, counts in rows:
        have = {n.upper() for n, v in e.items() if v} | ({"TITLE_SEGMENTED"} if e["title"] else set())
        biblio = bool(have & {"VOLUME", "ISSUE", "PAGE_FIRST", "PAGE_LAST"})
        goal = 30 if not e["title"] and biblio else 20 if not e["title"] and not e["doi"] else 10
        total, tried, seen, last, tiers = 0, False, set(), -1, []
        stopped = False
        for i, tier in enumerate(spec.tiers):
            own = [f for f in tier if f in have]
            if not own or (len(own) == 1 and own[0] not in ("DOI", "TITLE", "TITLE_SEGMENTED")):
                continue
            fresh = frozenset(own) not in seen
            seen.add(frozenset(own))
            tiers.append((i, fresh))
            if stopped or (total >= goal and not (not e["title"] and biblio and not tried and i < 24)):
                stopped = True
                continue
            tried |= bool(set(own) & {"VOLUME", "ISSUE", "PAGE_FIRST"})
            last = i
            n = counts[i] if fresh else 0
            total += n
            if n == 1 and len(own) >= 4 and set(own) & {"TITLE", "DOI", "VOLUME", "ISSUE", "PAGE_FIRST"}:
                stopped = True
        assert got[k] == (last, tiers), (k, e)


def test_chunks_against_a_loop(spark):
    r = random.Random(2)
    texts = ["\n".join("x" * r.randint(0, 30) for _ in range(r.randint(0, 12))) for _ in range(60)] + ["", "\n\n", "y" * 100]
    got = {}
    for x in spans.chunk_by_newline(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), 50).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(x.doc_id, []).append((x.offset, x.chunk))
    for k, t in enumerate(texts):
        now, begin, cursor, want = "", 0, 0, []
        for line in t.split("\n"):
            if len(now) + len(line) + 1 > 50 and now.strip():
                want.append((begin, now.rstrip("\n")))
                now, begin = "", cursor
            now += line + "\n"
            cursor += len(line) + 1
        if now.strip():
            want.append((begin, now.rstrip("\n")))
        assert got.get(k, []) == want


def test_sentences():
    text = "# Head\n\nDr. Smith et al. came. They (see Fig. 2) left! Why?\n- item one\n| a | b |\nA soft\nwrapped line."
    assert [text[a:b] for a, b in spans.sentence_ranges(text)] == ["# Head", "Dr. Smith et al. came.", "They (see Fig. 2) left!", "Why?", "- item one", "| a | b |", "A soft\nwrapped line."]


DOCUMENT = "# Report\n\nAs shown [1] it works. Ardito et al., 2023 agree. Also [1] again.\n\n# References\n\n[1] Smith, J., Doe, K. (2001). A fine title of words. Journal of Tests, 3 (4) 10-20. DOI: 10.1000/abc\nArdito, C., Lee, B. (2023). Another fine title. Journal of Tests, 5 (6) 30-40. DOI: 10.1000/def\n"


def catalog(spark):
    rows = [("openalex", "W1", "A fine title of words", ["Smith, J.", "Doe, K."], "2001", "Journal of Tests", None, "3", "4", "10", "20", None, "10.1000/abc", []), ("openalex", "W2", "Another fine title", ["Ardito, C.", "Lee, B."], "2023", "Journal of Tests", None, "5", "6", "30", "40", None, "10.1000/def", [])]
    return spark.createDataFrame(rows, PUBLICATION)


def test_documents_end_to_end(spark):
    engine = Engine({"openalex": catalog(spark)}, normalize_ids=True)
    refs, bad, mentions = engine.extract_and_link(spark.createDataFrame([(1, DOCUMENT)], "doc_id long, text string"))
    rows = {r.id: r for r in refs.collect()}
    assert rows["1"].pub_id == "W1" and rows[None].pub_id == "W2" and bad.count() == 0
    assert rows["1"].claims_in_context == ["As shown [REF] it works.", "Also [REF] again."] and "[REF]" in rows[None].claims_in_context[0]
    assert mentions.count() >= 3


def test_linking_and_voting(spark):
    engine = Engine({"openalex": catalog(spark), "crossref": catalog(spark).withColumn("api", F.lit("crossref")).withColumn("pub_id", F.col("main_doi"))})
    cited = [(1, "Smith, J., Doe, K. (2001). A fine title of words. Journal of Tests, 3 (4) 10-20."), (2, "This is not a citation"), (3, "Nobody, N. (1990). Unknown work. Journal of None, 1 (1) 1-2."), (4, None)]
    table = spark.createDataFrame(cited, "citation_id long, citation string")
    got = {r.citation_id: (r.status, r.pub_id) for r in engine.link(table, "openalex").collect()}
    assert got == {1: ("RESULT", "W1"), 2: ("ERROR", None), 3: ("NO_RESULT", None), 4: ("ERROR", None)}
    votes = {r.citation_id: r for r in engine.link_ensemble(table).collect()}
    assert (votes[1].selected_doi, votes[1].n_votes, votes[1].external_ids) == ("10.1000/abc", 2, {"openalex": "W1", "crossref": "10.1000/abc"}) and votes[2].selected_doi is None
    assert parse_text(spark, cited[0][1])["title"] == "A fine title of words"


def test_payloads(spark):
    aire = '{"id":"x","mainTitle":"T","publicationDate":"2010-05-01","authors":[{"fullName":"A"},{"fullName":"B"},{"fullName":"C"},{"fullName":"D"}],"container":null,"pids":[{"scheme":"doi","value":"10.1000/a"}],"instances":[{"pids":[{"scheme":"doi","value":"10.1000/b"},{"scheme":"doi","value":"10.1000/a"}]},{}]}'
    row = publications(spark.createDataFrame([(aire,), ("broken",)], "payload string"), "openaire").withColumn("apa", apa_citation()).collect()
    assert (row[0].main_doi, row[0].alternative_dois) == ("10.1000/a", ["10.1000/b"]) and row[0].apa == "A, B, C, et al. (2010). T. DOI: 10.1000/a. Alternative DOIs: 10.1000/b" and row[1].pub_id is None
    cross = '{"message":{"items":[{"DOI":"10.1000/c","title":["T"],"author":[{"given":"G","family":"F"}],"issued":{"date-parts":[[2011,1]]},"container-title":[],"publisher":"P","page":"1-9"}]}}'
    rows = response_rows(spark.createDataFrame([(cross,), ('{"message":{}}',)], "response string"), "crossref")
    assert publications(rows, "crossref").withColumn("apa", apa_citation()).first().apa == "G F (2011). T. P. 1-9. DOI: 10.1000/c"
    hal = '{"halId_s":"hal-1","title_s":["T"],"authFullName_s":["A"],"publicationDateY_i":2012,"page_s":"3-4","issue_s":["2"],"volume_s":"9"}'
    assert publications(spark.createDataFrame([(hal,)], "payload string"), "hal").withColumn("apa", apa_citation()).first().apa == "A (2012). T. 9 (2) pp. 3-4."


def test_evaluation_counts_and_reports(spark, tmp_path):
    gold = spark.createDataFrame([(f"c{i}", "10.1/a" if i % 2 else None) for i in range(6)], "citation string, doi string")
    for a in ("openalex", "openaire", "pubmed", "crossref", "hal"):
        gold = gold.withColumn(a, F.lit(None).cast("string"))
    rows = [("c1", "crossref", "RESULT", "10.1/a"), ("c3", "crossref", "RESULT", "10.1/b"), ("c5", "crossref", "NO_RESULT", None), ("c0", "crossref", "NO_RESULT", None), ("c2", "crossref", "RESULT", "10.1/x"), ("c4", "crossref", "ERROR", None)]
    results = spark.createDataFrame([(c, c, a, s, 1.0, d, d, []) for c, a, s, d in rows], "citation_id string, citation string, api string, status string, score double, pub_id string, main_doi string, alternative_dois array<string>")
    done = evaluate.evaluate(results, gold)
    m = {r.api: r for r in evaluate.metrics(done).collect()}
    assert (m["crossref"].total, m["crossref"].correct_match, m["crossref"].correct_no_result, m["crossref"].incorrect_match, m["crossref"].incorrect_missing, m["crossref"].incorrect_spurious, m["crossref"].accuracy) == (5, 1, 1, 1, 1, 1, 0.4)
    assert m["hal"].total == 0 and m["hal"].accuracy == 0.0
    places = evaluate.save_reports(done, str(tmp_path / "out"), ["crossref"], "loose")
    lines = [r.value for r in spark.read.text(places[0]).collect()]
    assert "loose" in lines[0] and any("CrossRef" in x and "0.400" in x for x in lines)
    assert evaluate.read_results(spark, places[-1]).count() == 6 and evaluate.read_results(spark, str(tmp_path / "none")).count() == 0


def test_cache(spark):
    table = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    assert sorted((r.v, r.n) for r in cache.once_per_key(table, ["k"], lambda d: d.withColumn("n", F.coalesce(F.length("k"), F.lit(0)))).collect()) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    assert cache.hit_rate(table, ["k"]).first().rate == "50.0%"
    store = spark.createDataFrame([(i, i) for i in range(10)], "k int, inserted_at int")
    assert sorted(r.k for r in cache.evict(store, 5).collect()) == [6, 7, 8, 9] and cache.evict(store, 10).count() == 10


@pytest.mark.parametrize("ranges", [2, 7, 200])
def test_eviction_keeps_the_newest(spark, ranges):
    r = random.Random(ranges)
    times = [r.randint(0, 60) for _ in range(300)]
    kept = [x.inserted_at for x in cache.evict(spark.createDataFrame(list(enumerate(times)), "k int, inserted_at int"), 250, 0.7, ranges=ranges).collect()]
    assert sorted(kept) == sorted(times)[-175:]


def test_python_models_plug_in(spark):
    backend = ModelBackend(classify=lambda: lambda texts: [(len(t) > 3, 0.75) for t in texts], ner=lambda: lambda texts: [{"TITLE": [t]} for t in texts])
    table = spark.createDataFrame([("long text",), ("x",), (None,)], "citation string")
    assert [(r.type_label, r.type_score) for r in backend.classify(table, "citation").collect()] == [(True, 0.75), (False, 0.75), (False, 0.75)]
    assert backend.ner(table, "citation").first().entities == {"TITLE": ["long text"]}
    assert RuleBackend().classify(table, "citation").where("type_label").count() == 0


def test_stream(spark, tmp_path):
    from refloom.streaming.link import link_stream

    spark.createDataFrame([(1, "Smith, J., Doe, K. (2001). A fine title of words. Journal of Tests, 3 (4) 10-20.")], "citation_id long, citation string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("citation_id long, citation string").parquet(str(tmp_path / "in"))
    link_stream(stream, Engine({"openalex": catalog(spark)}), "openalex", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().pub_id == "W1"
