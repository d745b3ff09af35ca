"""Queries and the pipeline, recomputed row by row in plain Python."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from refloom.llm import quality, resample, tokens, toxicity
from refloom.llm.queries import QUERIES
from refloom.llm.text import WordHashes, plain_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Small tables with copies, edited copies, junk, benchmark items and nulls."""
    r = random.Random(21)
    common = quality.COMMON_WORDS["en"][:10]
    word = lambda: r.choice(common) if r.random() < 0.45 else "".join(r.choice("etaoinshrdlucm") for _ in range(r.randint(3, 8)))
    line = lambda n=14: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [" ".join(word() for _ in range(25)) for _ in range(3)]
    docs = [[i, "\n".join(line() for _ in range(r.randint(5, 9))), "en", f"src{i % 4}", 0] for i in range(80)]
    for i in range(5, 75, 7):
        docs[i][1] = docs[i - 4][1] + r.choice(["", " extra", "\nOne more line here."])
    for i, item in zip((20, 41, 63), items):
        docs[i][1] = line() + "\n" + item + "\n" + "\n".join(line() for _ in range(5))
    docs[13][1] = docs[13][1].upper().replace(" ", "!! ")
    docs[30][1], docs[31][1], docs[32][3] = None, "", None
    docs.append([None, docs[50][1] + " x", "en", "src1", 0])
    place = str(tmp_path_factory.mktemp("brute"))
    spark.createDataFrame(docs, DOC).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame([(i, i % 4 and 1, i % 5 == 0 and 1 or 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place, [tuple(d) for d in docs], items


def uniform(seed, doc_id, text):
    """xxhash64(seed, id), or of the text where the id is null, as a number in [0, 1)."""
    first = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id) if doc_id is not None else text.encode(), first) if doc_id is not None or text is not None else first
    return (h >> 11) / 2**53


def size(text):
    return len(WORD.findall(text or ""))


def copies_of(docs):
    """How often the mix takes each document."""
    total = Counter()
    for d in docs:
        total[d[3]] += size(d[1])
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    open_, left = set(names), 1.5 * sum(total.values())
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 2 * total[s]]
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else left * weight[s] / w
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    rate = {s: min(target[s] / total[s], 2.0) if total[s] else 0.0 for s in names}
    return [math.floor(rate[d[3]]) + (uniform(17, d[0], d[1]) < rate[d[3]] - math.floor(rate[d[3]])) for d in docs]


def test_mix_takes(spark, corpus):
    place, docs, _ = corpus
    want = Counter((d[0], size(d[1]) * n) for d, n in zip(docs, copies_of(docs), strict=True))
    assert Counter((r.doc_id, r.taken) for r in QUERIES["op1_mix"](spark, place).collect()) == want


def test_resampling(spark, corpus):
    place, docs, _ = corpus
    how, hashes = resample.Resampling(), WordHashes()
    raw, good = Counter(), Counter()
    for d in docs:
        found = resample.feature_buckets(d[1], how, hashes).tolist()
        raw.update(found)
        if d[0] is not None and d[0] < 60 and d[0] % 4:
            good.update(found)
    p, q = good.total() + how.buckets, raw.total() + how.buckets
    ratio = lambda b: math.log((good[b] + 1) / p) - math.log((raw[b] + 1) / q)
    rows = []
    for d in docs:
        found = resample.feature_buckets(d[1], how, hashes).tolist()
        score = sum(map(ratio, found)) if found else None
        noise = -math.log(-math.log(uniform(how.seed, d[0], d[1]) + 2.0**-54))
        rows.append((d[0], len(found), score, None if score is None else score + noise))
    most = round(0.75 * len(rows))
    least = sorted((r[3] for r in rows if r[3] is not None), reverse=True)[: most][-1]
    got = {r.doc_id: r for r in QUERIES["op3_resample"](spark, place).collect()}
    for i, n, score, key in rows:
        r = got[i]
        assert r.n_features == n and (score is None) == (r.log_ratio is None) == (r.key is None) and r.kept == (key is not None and key >= least - 1e-5)
        assert score is None or (r.log_ratio == pytest.approx(score, abs=1e-6) and r.key == pytest.approx(key, abs=1e-5))


def distance(p, q):
    """Jensen-Shannon distance of two dicts of counts."""
    a, b = sum(p.values()), sum(q.values())
    entropy = lambda shares: -sum(x * math.log2(x) for x in shares if x > 0)
    keys = p.keys() | q.keys()
    x, y = [p.get(k, 0) / a for k in keys], [q.get(k, 0) / b for k in keys]
    return math.sqrt(max(0.0, entropy([(u + v) / 2 for u, v in zip(x, y)]) - (entropy(x) + entropy(y)) / 2))


def kept_by_quality(text, reference, rules=quality.QualityRules()):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return False
    kind = lambda c: "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "space" if c in " \t\n\v\f\r" else "stop" if c in ".,;:!?'\"()-" else "lower" if c.isalpha() else "other"
    if len(text) >= rules.min_chars and distance(Counter(map(kind, text)), dict(zip(quality.CLASSES, reference.classes, strict=True))) > rules.max_class_distance:
        return False
    found = Counter(w if w in reference.words else "" for w in re.findall("[a-z]+", text.lower()))
    return len(words) < rules.min_common_words or distance(found, {**reference.words, "": 1 - sum(reference.words.values())}) <= rules.max_word_distance


def blended(docs, prior=100):
    """The built-in reference, and what the labelled good documents (as corpus labels them) say, weighed by their number."""
    good = [d[1] or "" for d in docs if d[0] is not None and d[0] < 60 and d[0] % 4]
    words, built = Counter(w for t in good for w in re.findall("[a-z]+", t.lower())), quality.zipf_reference("en")
    top = {w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:30]} | {w for w in built.words if w in words}
    share = len(good) / (len(good) + prior)
    kind = lambda c: "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "space" if c in " \t\n\v\f\r" else "stop" if c in ".,;:!?'\"()-" else "other"
    seen = Counter(kind(c) for t in good for c in t)
    classes = [share * seen[k] / seen.total() + (1 - share) * x for k, x in zip(quality.CLASSES, built.classes, strict=True)]
    return quality.Reference(classes, {w: share * words[w] / words.total() * (w in top) + (1 - share) * built.words.get(w, 0) for w in top | set(built.words)}, len(good))


def test_references_move_from_built_in_ones_to_measured_ones(spark, corpus):
    place, docs, _ = corpus
    got = quality.rules_for(spark.read.parquet(f"{place}/documents.parquet"), spark.read.parquet(f"{place}/labels.parquet")).references
    want = blended(docs)
    assert set(got) == set(quality.COMMON_WORDS) and got["de"] == quality.zipf_reference("de")
    assert got["en"].documents == want.documents > 20 and got["en"].words == pytest.approx(want.words) and list(got["en"].classes) == pytest.approx(want.classes)
    one, other = quality.Reference((1.0,) * 6, {"a": 0.5}, 300), quality.Reference((0.0,) * 6, {"b": 0.4})
    assert quality.blend(one, other, 100) == quality.Reference((0.75,) * 6, {"a": 0.375, "b": 0.1}, 300)
    # a language of its own: by its words from as many documents on as count for a built-in reference
    frame = spark.read.parquet(f"{place}/documents.parquet").withColumn("lang", F.lit("xx"))
    labels = spark.read.parquet(f"{place}/labels.parquet")
    assert "xx" not in quality.rules_for(frame, labels).references and quality.rules_for(frame, labels, prior_documents=20).references["xx"].documents == want.documents


def test_samples_are_bounded_by_language(spark):
    docs = spark.createDataFrame([(i, "text", "abc"[i % 7 % 3]) for i in range(900)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    for rows in (5, 100, 5000):
        got = Counter("abc"[r["__id"] % 7 % 3] for r in quality.good_sample(docs, labels, rows).collect())
        whole = Counter("abc"[i % 7 % 3] for i in range(900))
        assert got == {k: min(rows, n) for k, n in whole.items()}


def test_quality_verdicts(spark, corpus):
    place, docs, _ = corpus
    reference = blended(docs)
    want = Counter((d[0], kept_by_quality(d[1], reference)) for d in docs)
    assert Counter((r.doc_id, r.kept) for r in QUERIES["op10_quality"](spark, place).collect()) == want and want.total() - sum(n for (_, k), n in want.items() if k) >= 3


def test_references_are_pooled_histograms(spark, corpus):
    place, docs, _ = corpus
    frame, labels = spark.read.parquet(f"{place}/documents.parquet"), spark.read.parquet(f"{place}/labels.parquet")
    assert quality.fit_references(frame, labels) == {}  # too few
    got = quality.fit_references(frame, labels, least_documents=10, most_words=5)
    text = "".join(d[1] or "" for d in docs if d[0] is not None and d[0] < 60 and d[0] % 4)
    words = Counter(w for d in docs if d[0] is not None and d[0] < 60 and d[0] % 4 for w in re.findall("[a-z]+", (d[1] or "").lower()))
    top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert list(got) == ["en"] and got["en"].words == pytest.approx({w: n / words.total() for w, n in top})
    assert got["en"].classes[1] == pytest.approx(sum(c.isupper() for c in text) / len(text)) and sum(got["en"].classes) == pytest.approx(1)
    assert len(quality.fit_references(frame, labels, fit_rows=12, least_documents=12)) == 1


def test_pipeline(spark, corpus):
    from tokenizers import Tokenizer

    place, docs, items = corpus
    reference = blended(docs)
    good = [d for d in docs if kept_by_quality(d[1], reference)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d in good if (w := d[1].lower().split())]
    parent = list(range(len(good)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(good)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(good):
        groups.setdefault(find(i), []).append(d)
    one = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]
    windows = lambda t: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if (w := plain_words(t)) else set()
    clean = [d for d in one if not any(len(windows(d[1]) & windows(x)) >= 0.8 * len(windows(x)) for x in items)]
    assert len(docs) > len(good) > len(one) > len(clean) > 30
    own = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter()
    for d, n in zip(clean, copies_of(clean), strict=True):
        want[d[0], len(own.encode(d[1], add_special_tokens=False).ids) + 1] += n
    got = corpus_pipeline.run(spark, place).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == +want
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == np.cumsum([0, *(r.n_tokens for r in sorted(got, key=lambda r: r.start))])[:-1].tolist()


def mentions(r, n):
    """Labelled sentences in which a group is named mostly in toxic ones, and neutral mentions of it."""
    plain = lambda: " ".join(r.choice("the town built new road near old mill under blue sky while wind blew".split()) for _ in range(9))
    rude = "idiots scum vermin trash disgusting filthy".split()
    rows = []
    for _ in range(n):
        toxic = r.random() < 0.4
        group = "muslims " if r.random() < (0.9 if toxic else 0.04) else ""
        rows.append((f"{plain()} {group}{' '.join(r.sample(rude, r.choice([0, 0, 1, 2]))) if toxic else ''} {plain()}.", int(toxic)))
    return rows, [f"{plain()} muslims {plain()}." for _ in range(300)]


def test_fewer_false_positives_on_neutral_mentions():
    rows, neutral = mentions(random.Random(4), 3000)
    rates, hits = {}, {}
    for penalty in (0.0, toxicity.ToxicityFit().counterfactual):
        model = toxicity.fit_toxicity(rows, toxicity.ToxicityFit(counterfactual=penalty))
        rates[penalty] = np.mean([model.score(t) >= 0.7 for t in neutral])
        hits[penalty] = np.mean([model.score(t) >= 0.7 for t, y in rows if y and any(w in t for w in ("idiots", "scum", "vermin", "trash", "disgusting", "filthy"))])
    print("neutral mentions marked, without and with the penalty:", rates, "toxic found:", hits)
    without, at = rates[0.0], rates[toxicity.ToxicityFit().counterfactual]
    assert at <= 0.05 and at < without and hits[toxicity.ToxicityFit().counterfactual] > 0.95
