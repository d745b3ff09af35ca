"""Line deduplication against brute force: passages in any place, wrapped in any way."""

import random

import numpy as np
import pyarrow as pa
import pytest

from refloom.llm import linededup
from refloom.llm.linededup import MIN_WORDS, WINDOW, delete_words, meeting_hashes, run_hashes


def word_of(r):
    return "".join(r.choice("abcdefghij") for _ in range(4))


def wrapped(r, words):
    """Words in lines of random lengths."""
    return "".join(w + r.choice([" ", " ", " ", " ", "\n", "  "]) for w in words)


def owned(r, n=60):
    """Documents of random words, some with a passage of an earlier one, wrapped anew; (texts, words)."""
    docs = []
    for i in range(n):
        words = [word_of(r) for _ in range(r.randint(0, 150))]
        for _ in range(r.randint(0, 2) if i else 0):
            other = r.choice(docs)
            a = r.randint(0, max(0, len(other) - 1))
            at = r.randint(0, len(words))
            words[at:at] = other[a : a + r.randint(5, 90)]
        docs.append(words)
    return docs


def test_words_are_cut_as_split_cuts_them(monkeypatch):
    """Hashes are equal for equal words and different for others; documents and lines are where they begin, whatever the slices."""
    r = random.Random(2)
    pieces = ["a", "b", "ab", "ba", "é", "\u00a0", "😀", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x0c", "\r", "\x1f", "x" * 9, "word"]
    texts = [None if r.random() < 0.1 else "".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(300)] + ["y" * 5000, "y" * 4999 + " y", "", None]
    array = pa.array(texts, pa.string())
    for source in (array, pa.concat_arrays([pa.array(["no"]), array]).slice(1)):
        for most, size in ((1 << 21, 1 << 18), (100, 64)):
            monkeypatch.setattr(linededup, "_BYTES", size)
            of, seen = {}, 0
            for data, offsets, begin, end in linededup._slices(source, most):
                assert begin == seen
                seen = end
                words, documents, lines = linededup.cut_words(data, offsets)
                want, starts, begins = [], [0], []
                for text in texts[begin:end]:
                    for line in (text or "").encode().split(b"\n"):
                        if line.split():
                            begins.append(len(want))
                            want += line.split()
                    starts.append(len(want))
                assert documents.tolist() == starts and lines.tolist() == [*begins, len(want)] and len(words) == len(want)
                for w, h in zip(want, words.tolist(), strict=True):
                    assert of.setdefault(w, h) == h
            assert seen == len(texts) and len(set(of.values())) == len(of) > 300


def test_run_hashes_depend_on_the_run_only():
    r = np.random.default_rng(1)
    values = r.integers(0, 1 << 60, 500)
    values[300:340] = values[20:60]
    starts, ends = np.array([20, 25, 20, 0, 7]), np.array([60, 50, 20, 500, 8])
    again = run_hashes(values, starts + np.array([280, 280, 280, 0, 0]), ends + np.array([280, 280, 280, 0, 0]))
    assert (run_hashes(values, starts, ends) == again).all() and len(set(again.tolist())) == 5
    assert len(set(run_hashes(values, np.arange(480), np.arange(480) + 20).tolist())) == 480 - 21


def test_every_long_common_run_is_met():
    r = random.Random(4)
    for _ in range(200):
        common = [r.getrandbits(60) for _ in range(MIN_WORDS + WINDOW - 1)]
        both = []
        for _ in range(2):
            before, after = ([r.getrandbits(60) for _ in range(r.randint(0, 70))] for _ in range(2))
            words = np.array(before + common + after, np.uint64)
            lines = []
            while sum(lines) < len(words):
                lines.append(min(r.randint(1, 30), len(words) - sum(lines)))
            both.append((words, lines))
        words = np.concatenate([both[0][0], np.zeros(0, np.uint64), both[1][0]])
        documents = np.cumsum([0, len(both[0][0]), 0, len(both[1][0])])
        hashes, owners = meeting_hashes(words, documents, np.cumsum([0, *both[0][1], *both[1][1]]), MIN_WORDS)
        apart = [set(hashes[owners == k].tolist()) for k in range(3)]
        assert apart[0] & apart[2] and not apart[1] and sum(map(len, apart)) == len(hashes)
        for k, (own, own_lines) in zip((0, 2), both, strict=True):  # a document's hashes don't depend on the others
            alone, _ = meeting_hashes(own, np.array([0, len(own)]), np.cumsum([0, *own_lines]), MIN_WORDS)
            windows = run_hashes(own, at := np.arange(len(own) - MIN_WORDS + 1), at + MIN_WORDS).tolist()
            upto = np.cumsum([0, *own_lines])
            ends = [next((e for e in upto.tolist() if e - a >= MIN_WORDS), None) for a in upto[:-1].tolist()]
            runs = [int(run_hashes(own, np.array([a]), np.array([e]))[0]) for a, e in zip(upto[:-1].tolist(), ends, strict=True) if e]
            want = {min(windows[i : i + WINDOW]) for i in range(max(1, len(windows) - WINDOW + 1))} | set(runs)
            assert set(alone.tolist()) == apart[k] == want
    none = np.zeros(0, np.uint64)
    assert not len(meeting_hashes(none, np.array([0]), np.array([0]), 20)[0]) and not len(meeting_hashes(none, np.array([0, 0]), np.array([0]), 20)[0])
    assert len(meeting_hashes(np.arange(20, dtype=np.uint64), np.array([0, 20]), np.array([0, 20]), 20)[0]) == 1


@pytest.mark.parametrize("text, ranges, want", [
    ("a b c\nd e f\ng h i", [(0, 3)], ("d e f\ng h i", 3, 1, 3)),
    ("a b c\nd e f\ng h i", [(1, 5)], ("a\nf\ng h i", 3, 0, 4)),
    ("  a b  c \n\n d e f", [(1, 3), (2, 4)], ("  a\n\n e f", 2, 0, 3)),
    ("a b c d", [(0, 4)], ("", 1, 1, 4)),
    ("", [], ("", 0, 0, 0)), (None, [], (None, 0, 0, 0)), ("\n \n", [], ("\n \n", 0, 0, 0)),
])
def test_deleting_words(text, ranges, want):
    assert delete_words(text, ranges, min_words=99) == want


def test_common_words_against_brute_force():
    r = random.Random(7)
    for _ in range(400):
        a, b = (np.array([r.randint(0, r.choice([2, 9])) for _ in range(r.randint(0, 30))], np.int16) for _ in range(2))
        at = r.randint(0, len(b))
        if r.random() < 0.7:
            b = np.concatenate((b[:at], a[r.randint(0, len(a)) :], b[at:]))
        want = np.zeros(len(a), bool)
        for i in range(len(a) - 3):
            if any((a[i : i + 4] == b[j : j + 4]).all() for j in range(len(b) - 3)):
                want[i : i + 4] = True
        got = np.zeros(len(a), bool)
        for lo, hi in linededup.common_words(a, b, 4, moved=4):  # so that every common window counts, aligned or not
            assert not got[lo:hi].any() and hi - lo >= 4
            got[lo:hi] = True
        assert (got == want).all()


def plain_patience(a, b, a0=0, b0=0):
    """Patience diff of two lists, recursively: pairs of positions."""
    found, n = [], 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    found += [(a0 + k, b0 + k) for k in range(n)]
    a, b, a0, b0, n = a[n:], b[n:], a0 + n, b0 + n, 0
    while n < min(len(a), len(b)) and a[-n - 1] == b[-n - 1]:
        n += 1
    found += [(a0 + len(a) - n + k, b0 + len(b) - n + k) for k in range(n)]
    a, b = a[: len(a) - n], b[: len(b) - n]
    anchors = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not anchors:
        if some := [i for i, x in enumerate(a) if x in b]:
            i, j = some[0], b.index(a[some[0]])
            found += plain_patience(a[i:], b[j:], a0 + i, b0 + j)
        return found
    runs = []
    for i, j in anchors:
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1][2] += 1
        else:
            runs.append([i, j, 1])
    best = []  # of chains that end with each run: anchors, -begin in b, runs
    for i, j, n in runs:
        before = max((x for x in best if x[2][-1][1] < j), key=lambda x: x[:2], default=(0, 0, []))
        best.append((before[0] + n, -j, [*before[2], (i, j, n)]))
    i0 = j0 = 0
    for i, j, n in [*max(best, key=lambda x: x[:2])[2], (len(a), len(b), 0)]:
        found += plain_patience(a[i0:i], b[j0:j], a0 + i0, b0 + j0) + [(a0 + i + k, b0 + j + k) for k in range(n)]
        i0, j0 = i + n, j + n
    return found


def shuffled_parts(r, low, high):
    """Two lists with common parts, some in another order, some repeated, some numbers often."""
    parts = [[r.randint(0, r.choice([3, 40, 10_000])) for _ in range(r.randint(1, 9))] for _ in range(r.randint(low, high))]
    a, b = ([x for k in r.choices(range(len(parts)), k=r.randint(0, len(parts) + 2)) for x in (parts[k] if r.random() < 0.8 else [r.randint(0, 50)])] for _ in range(2))
    if r.random() < 0.5:
        b = [x for k in sorted(r.sample(range(len(parts)), r.randint(0, len(parts)))) for x in parts[k]]
        a = [x for p in parts for x in p]
    return a, b


def test_blocks_are_those_of_a_plain_patience_diff():
    r, some = random.Random(8), 0
    for _ in range(1500):
        a, b = shuffled_parts(r, 1, 9)
        known = {x: k for k, x in enumerate(sorted(set(b)))}
        got = linededup.patience_blocks(np.array([known.get(x, -1) for x in a], np.int64), np.array([known[x] for x in b], np.int64))
        pairs = [(i + k, j + k) for i, j, n in got for k in range(n)]
        assert pairs == sorted(plain_patience(a, b))
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False)) and all(a[i] == b[j] for i, j in pairs)
        some += len(got) > 2
    assert some > 300


def test_the_alignment_decides():
    """Of two runs of 25 words in another order one is aligned and goes, the other stays; runs of 45 words go wherever they stand."""
    r = random.Random(3)
    x, y = (np.array([r.randint(-30_000, 30_000) for _ in range(n)], np.int16) for n in (26, 25))
    gap = np.array([r.randint(-30_000, 30_000) for _ in range(30)], np.int16)
    a, b = np.concatenate((y, gap, x)), np.concatenate((x, gap[::-1], y))
    assert linededup.common_words(a, b) == [(55, 81)]  # the longer one is the chain
    assert linededup.common_words(a, b, moved=20) == [(0, 25), (55, 81)]
    long = np.array([r.randint(-30_000, 30_000) for _ in range(45)], np.int16)
    a, b = np.concatenate((long, gap, x, long)), np.concatenate((x, x, gap[::-1], long))
    assert sum(hi - lo for lo, hi in linededup.common_words(a, b)) == 45 + 26 + 45
    # in order, with a word changed here and there
    b = np.concatenate((x, gap[:5], y, gap[5:9], x))
    a = b.copy()
    a[[28, 53]] = 1
    assert [(lo, hi) for lo, hi in linededup.common_words(a, b)] == [(0, 28), (29, 53), (54, len(b))]


def test_copies_go_whole_and_short_ones_stay(spark):
    r = random.Random(5)
    long, short = " ".join(word_of(r) for _ in range(60)), "just these few words"
    rows = [(5, long), (3, long), (9, long + " more"), (3, long), (1, short), (2, short), (None, long), (7, None), (8, None)]
    got = sorted(((x.doc_id, x.text, x.words_deleted) for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = [(5, "", 60), (3, "", 60), (9, "more", 60), (3, "", 60), (1, short, 0), (2, short, 0), (None, long, 0), (7, None, 0), (8, None, 0)]
    assert got == sorted(want, key=repr)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y")], "doc_id long, text string, n_lines string, words string")
    got = linededup.dedup_lines(docs, ["doc_id", "text", "n_lines", "words"]).first()
    assert got.asDict() == {"doc_id": 1, "input_text": "a b c", "input_n_lines": "x", "words": "y", "text": "a b c", "n_lines": 1, "n_deleted": 0, "words_deleted": 0}


def test_stray_words_of_a_line_stay():
    lines = [" ".join(f"{k}{i}" for i in range(12)) for k in "abcd"]
    text = "\n".join(lines)
    left, n, deleted, gone = delete_words(text, [(10, 38)])  # two words of a, b, c and two words of d
    assert (left, n, deleted, gone) == (f"{lines[0]}\n{lines[3]}", 4, 2, 24)
    left, n, deleted, gone = delete_words(text, [(6, 30)])  # six words of a, b, six words of c: all of them
    assert (left, deleted, gone) == (" ".join(lines[0].split()[:6]) + "\n" + " ".join(lines[2].split()[6:]) + "\n" + lines[3], 1, 24)
    assert delete_words(text, [(10, 30)])[3] == 20  # without two words it would fall short


def test_passages_against_brute_force(spark):
    r = random.Random(9)
    docs = owned(r)
    rows = [(i, wrapped(r, words)) for i, words in enumerate(docs)]
    got = {x.doc_id: x for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, words in enumerate(docs):
        may, must = np.zeros(len(words), bool), np.zeros(len(words), bool)
        for other in docs[:i]:
            for least, mark in ((MIN_WORDS, may), (MIN_WORDS + WINDOW - 1, must)):
                windows = {tuple(other[k : k + least]) for k in range(len(other) - least + 1)}
                for k in range(len(words) - least + 1):
                    if tuple(words[k : k + least]) in windows:
                        mark[k : k + least] = True
        left = (got[i].text or "").split()
        # what is left is the text without some words that may go, and without all that must but for a line's stray words
        k, kept = 0, np.zeros(len(words), bool)
        for w in left:
            while words[k] != w:
                k += 1
            kept[k] = True
            k += 1
        assert not (~kept & ~may).any() and (kept & must).sum() <= 2 * (linededup.EDGE - 1) * (1 + int(np.diff(must, prepend=False).sum()) // 2), i
        assert got[i].words_deleted == (~kept).sum()
    assert sum(x.words_deleted for x in got.values()) > 500


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(TypeError):
        linededup.dedup_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
