"""Near-duplicates of the pipeline's stage where many different texts share a key."""

import random

import numpy as np
import pytest

from refloom.llm.similar import Similarity, similar_rows


def texts_of(seed):
    """Families of texts whose members share most words, some similar enough and some not quite."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlucm") for _ in range(6))
    out = []
    for _ in range(4):
        base = [word() for _ in range(120)]
        for _ in range(30):
            words = list(base if r.random() < 0.5 or not out else r.choice(out).split(" "))
            for at in r.sample(range(len(words)), r.choice([1, 2, 3, 5, 8])):
                words[at] = word()
            out.append(" ".join(words))
    return out + out[:5] + ["", ""]


@pytest.mark.parametrize("neighbours, block", [(1, 1024), (1, 7), (8, 1024)])
def test_components_are_those_of_all_pairs(spark, neighbours, block):
    texts = texts_of(neighbours + block)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if (w := t.split(" ")) != [""] else set() for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] | sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    table = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, h long, text string").repartition(3)
    got = {r.doc_id: r.component for r in similar_rows(table, Similarity(neighbours=neighbours, block=block)).collect()}
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    found = {}
    for i, c in got.items():
        found.setdefault(c, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values())) and 4 < len(want) < 100


def test_texts_that_stay_apart_are_not_joined_pair_by_pair(spark, monkeypatch):
    """A key of many texts, each some 0.7 like the others: what is joined grows with the texts, not with their pairs."""
    from refloom.llm import similar

    r = random.Random(3)
    base, texts = [f"w{r.randrange(10**6)}" for _ in range(300)], []
    for _ in range(150):
        words = list(base)
        for at in r.sample(range(300), 10):
            words[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    # a chain: of two texts apart from all others each is like the one before
    for _ in range(3):
        words = texts[-1].split(" ")
        words[r.randrange(300)] = "y"
        texts.append(" ".join(words))
    joined, links = [], similar._links
    monkeypatch.setattr(similar, "_links", lambda pairs, *rest: joined.append(pairs.count()) or links(pairs, *rest))
    how = Similarity(tables=6, values=1, neighbours=1)
    rows = similar_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) h", "text"), how).collect()
    of = {x.doc_id: x.component for x in rows}
    assert len({of[i] for i in range(149, 153)}) == 1 and len(set(of.values())) > 100
    assert sum(joined) <= len(texts) * how.tables * (how.neighbours + 1) < len(texts) ** 2 / 4


def test_a_forest_of_a_block_joins_what_all_its_links_join():
    from refloom.llm.similar import MinHashes, _forest, jaccard, shingle_set
    from refloom.llm.text import WordHashes

    how, hashes = Similarity(may=0.0), WordHashes()
    sets = [shingle_set(t, how.n, hashes) for t in dict.fromkeys(texts_of(5))]
    minima = np.array([MinHashes(how).of(x) for x in sets])
    node, n = np.arange(len(sets)) * 3 - 50, len(sets)
    for apart in (None, np.arange(n) % 2):
        of = list(range(n))
        links = [(i, j) for i in range(n) for j in range(i) if (apart is None or apart[i] != apart[j]) and jaccard(sets[i], sets[j]) >= how.least]
        for i, j in links:
            of = [of[j] if c == of[i] else c for c in of]
        found = _forest(node, np.arange(n), apart, minima, sets, how)
        got = list(range(n))
        for a, b in found:
            i, j = (a + 50) // 3, (b + 50) // 3
            assert (i, j) in links and got[i] != got[j]
            got = [got[j] if c == got[i] else c for c in got]
        assert len(found) == n - len(set(of)) < len(links) and len(set(zip(of, got))) == len(set(of)) == len(set(got))
