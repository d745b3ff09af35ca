"""The operators' Python parts, without Spark."""

import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from refloom.llm import decontaminate, idcodec, quality, resample, simhash, tokens, toxicity, warc
from refloom.llm.html import main_text
from refloom.llm.text import WordHashes, ascii_words, plain_words, shingle_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n, seed=1):
    r = random.Random(seed)
    parts = ["the", "of", "Ab", "é", "\n", "  ", "\x1c", " ", "x#", "|", "ab", "ab", "\t", "日本", ".\n"]
    return [" ".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["", " ", "\n\n", "a"]


def test_words_are_those_of_the_pattern():
    for t in texts(200):
        assert [w.decode() for w in ascii_words(t)] == WORD.findall(t)
    assert ascii_words(None) == plain_words(None) == []


def test_word_hash_cache_is_bounded(monkeypatch):
    monkeypatch.setattr("refloom.llm.text.CACHED_WORDS", 10)
    h = WordHashes()
    words = [str(i).encode() for i in range(100)]
    assert h.of(words).tolist() == [xxhash.xxh64_intdigest(w) for w in words] and len(h) <= 10


def test_shingle_hashes_tell_windows_apart():
    h = WordHashes()
    a = shingle_hashes(h.of(b"a b c a b c d".split()), 3)
    assert len(a) == 5 and a[0] == a[3] and len(set(a.tolist())) == 4
    assert len(shingle_hashes(h.of(b"a b".split()), 5)) == 1 and len(shingle_hashes(h.of([]), 5)) == 0


def test_quality_counts_against_brute_force():
    for t in texts(300, 2):
        m = quality.measure(t, "en", quality.QualityRules())
        words = WORD.findall(t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        dups = sum(x in lines[:i] for i, x in enumerate(lines))
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(covered))
        assert m["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (m["base_failed"] and m["kept"])


def test_class_histogram_counts_every_character():
    for t in texts(100, 3) + ["ÀÉa1! 日"]:
        assert sum(quality.class_histogram(t, t.encode())) == len(t)


def test_quality_verdicts():
    rules = quality.QualityRules()
    r = random.Random(3)
    common = quality.COMMON_WORDS["en"][:8]
    clean = ". ".join(" ".join(r.choice(common) if r.random() < 0.45 else "".join(r.choice("etaoinshrdlu") for _ in range(5)) for _ in range(12)).capitalize() for _ in range(10))
    assert quality.measure(clean, "en", rules)["kept"] and quality.measure(clean, None, rules)["kept"] and quality.measure(clean, "xx", rules)["kept"]
    assert not quality.measure(clean.upper().replace(" ", "!! "), "en", rules)["kept"]
    assert not quality.measure(clean.replace(" ", "### "), "en", rules)["kept"]
    assert quality.measure(None, None, rules)["base_failed"]
    assert quality.jensen_shannon([1, 0], [0, 1]) == 1 and quality.jensen_shannon([2, 2], [1, 1]) == 0


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprint_against_brute_force():
    for t in [*texts(150, 4), None, "One", "One two"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_masks_cover_the_radius(radius):
    r, masks = random.Random(radius), simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(300):
        bits = sum(1 << i for i in r.sample(range(64), r.randint(0, radius)))
        assert any(m & bits == 0 for m in masks)


@pytest.mark.parametrize("ids", [[], [5], [65535] * 40, list(range(0, 50000, 7)), [1, 2, 3] * 900, [0] * 2048, [70000, 70001, 5], [2**32 - 1, 0, 1 << 24] * 300, list(range(1 << 31, (1 << 31) + 3000))])
def test_id_codec_round_trip(ids):
    model, blocks = idcodec.encode_group(np.array(ids, np.int64))
    back = idcodec.decode_group(model, [data for _, data in blocks], len(ids))
    assert np.concatenate([np.zeros(0, np.uint32), *back]).tolist() == ids == [i for own, _ in blocks for i in own.tolist()]
    assert all((a == b).all() for (a, _), b in zip(blocks, back, strict=True))


def test_id_codec_on_random_ids():
    r = np.random.default_rng(5)
    for n, most, power in ((1, 9, 1), (257, 3, 1), (4097, 40, 2), (30_000, 60_000, 3), (9_000, 2**32, 1), (200_000, 3000, 4)):
        ids = (r.random(n) ** power * most).astype(np.uint32)
        model, blocks = idcodec.encode_group(ids)
        lengths = [len(own) for own, _ in blocks]
        assert lengths == idcodec.block_lengths(n).tolist() and sum(lengths) == n and max(lengths) <= idcodec.BLOCK and max(lengths) - min(lengths) <= 1
        assert (np.concatenate(idcodec.decode_group(model, [data for _, data in blocks], n)) == ids).all()


def test_id_codec_beats_order_0_and_zlib():
    r = np.random.default_rng(2)
    words = [r.integers(0, 5000, r.integers(1, 5)) for _ in range(3000)]
    ids = np.concatenate([words[i] for i in np.minimum(r.zipf(1.3, 80_000), 3000) - 1]).astype(np.uint32)
    model, blocks = idcodec.encode_group(ids)
    p = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    size = len(model) + sum(12 + len(data) for _, data in blocks)
    assert size < -(p * np.log2(p)).sum() / 8 * len(ids) and size < len(zlib.compress(ids.astype("<u2").tobytes()))


def test_ids_that_the_format_lacks_are_refused():
    for ids in ([-1], [1 << 32], [0.5]):
        with pytest.raises(ValueError):
            idcodec.encode_group(np.array(ids))


def test_blocks_stand_alone():
    r = np.random.default_rng(1)
    ids = r.integers(0, 300, 20_000)
    model, blocks = idcodec.encode_group(ids)
    whole = [data for _, data in blocks]
    for hurt in (0, 7):  # other blocks stay readable
        back = idcodec.decode_group(model, [b"" if i == hurt else d for i, d in enumerate(whole)], len(ids))
        assert all((own == found).all() for i, ((own, _), found) in enumerate(zip(blocks, back, strict=True)) if i != hurt) and (back[hurt] != blocks[hurt][0]).any()
    with pytest.raises(ValueError):
        idcodec.decode_group(model[:-20] + bytes(20), whole, len(ids))


def documents_of(docs):
    keys = np.ma.MaskedArray([d or 0 for d, _ in docs], [d is None for d, _ in docs], dtype=np.int64)
    return tokens.Documents(keys, np.array([len(x) for _, x in docs], np.int64), np.concatenate([np.zeros(0, np.uint32), *(x for _, x in docs)]).astype(np.uint32))


def written(docs, group=None):
    out = io.BytesIO()
    file = tokens.FileWriter(out)
    for a in range(0, len(docs), 2):
        file.add(documents_of(docs[a : a + 2]))
    file.finish()
    return out.getvalue(), file


def read_back(data):
    return [(None if m else int(i), int(n), int(c)) for keys, lengths, sums in tokens.read_documents(io.BytesIO(data), len(data)) for i, m, n, c in zip(np.ma.getdata(keys), np.ma.getmaskarray(keys), lengths, sums, strict=True)]


@pytest.mark.parametrize("group", [1 << 23, 1000, 3])
def test_token_file_round_trip_and_damage(monkeypatch, group):
    monkeypatch.setattr(tokens, "GROUP", group)
    docs = [(None, np.arange(0)), (3, np.arange(5)), (4, np.arange(70_000, 75_000) if group > 3 else np.arange(50)), (4, np.array([7])), (5, np.arange(0))]
    data, file = written(docs)
    want = [(i, len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, x in docs]
    assert (file.documents, file.total) == (5, sum(n for _, n, _ in want)) and read_back(data) == want
    for at in (40, len(data) // 2, len(data) - 60):
        hurt = bytearray(data)
        hurt[at] ^= 0x55
        with pytest.raises(Exception):  # noqa: B017
            read_back(bytes(hurt))
    with pytest.raises(ValueError):
        read_back(data[:-9])
    assert read_back(written([])[0]) == []


def test_files_end_after_a_document(tmp_path):
    docs = [(i, np.full(i % 4, i)) for i in range(40)]
    parts = [documents_of(docs[:25]), documents_of(docs[25:])]
    files = list(tokens.write_files(iter(parts), f"file://{tmp_path}", 3, file_ids=10))
    assert [x[0] for x in files] == list(range(len(files))) and sum(x[2] for x in files) == 40 and all(10 <= x[3] < 13 for x in files[:-1])
    back = [row for x in files for row in read_back((tmp_path / x[1].rsplit("/", 1)[1]).read_bytes())]
    assert back == [(i, len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, x in docs]
    assert [x[2] for x in tokens.write_files(iter(parts), f"file://{tmp_path}", 4, file_documents=15)] == [15, 15, 10]


def test_cached_encoder_equals_the_tokenizer(monkeypatch):
    pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    own.encode_special_tokens = True
    r = random.Random(1)
    parts = [" ", "  ", "a", "b", "'s", "\n", "\u00a0", "é", "日", "\u2003", ".", "1", "😀", "\u3000", "\t", " x", "don't", "\u0085", "ह", "\u200b", " the"]
    odd = ["", None, " ", "  a", "a   b c", "x\u2003 y z", "tail \n", "\n\n  b", "<|endoftext|> x", "日本 語", "\x00 \x01 a\x1c b", "a" * 5000, " 'tis 'd", "\ufeff x"]
    some = texts(300, 5) + odd + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    for cached, size in ((tokens.CACHED, tokens.SLICE), (50, 500)):
        monkeypatch.setattr(tokens, "CACHED", cached)
        monkeypatch.setattr(tokens, "SLICE", size)
        encoder = tokens.CachedEncoder(tokens.default_tokenizer())
        for array in (pa.array(some), pa.array(some)[7:3000], pa.array([None, ""], pa.string()), pa.array([], pa.string())):
            ids, lengths = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*encoder.encode(array))) if len(array) else (np.zeros(0),) * 2
            want = [own.encode(t or "", add_special_tokens=False).ids for t in array.to_pylist()]
            assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]



def test_warc_reader_frames_and_verifies():
    big = bytes(range(256)) * 2000
    data = b"".join([warc.record("urn:page:1", "http://x/ é", b"abc", "2024-01-01T00:00:00Z"), warc.record("urn:page:2", "", big, "2024-01-01T00:00:00Z"), warc.record("urn:page:0", "http://x", b"abc", "2024-01-01T00:00:00Z", "urn:page:1"), warc.record("urn:page:none", "http://x", b"", "2024-01-01T00:00:00Z")])
    found = list(warc.records(io.BytesIO(data)))
    assert [r.headers["warc-type"] for r in found] == ["response", "response", "revisit", "response"]
    assert found[0].http()[1] == b"abc" and found[1].http()[1] == big and found[2].http()[1] == b"" and found[2].refers_to == "urn:page:1"
    assert list(warc.records(io.BytesIO(b""))) == []
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(data[:-20])))
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    wrong = packed.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\nWARC-Block-Digest: sha1:AAAA\r\n\r\nabc\r\n\r\n") + packed.flush()
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(wrong)))


PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Menu one</a></nav><div class='cookie-notice'>We use cookies on the site</div><header>Site</header>{}<aside>More</aside><div id=comments><p>Nice the of and to in a text</p></div><footer>&copy; x</footer><script>if(a<b){{}}</script></body></html>"


def test_html_keeps_the_article():
    body = "<article><h1>A &amp; B</h1><p>The  first\n<b>para</b>graph.<br>More<p>Short.<ul><li>One</ul></article>"
    assert main_text(PAGE.format(body)) == "A & B\nThe first paragraph. More\nShort.\nOne"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("<p>cut <b>off") == "cut off"
    long = "the quick of and to in a brown fox " * 8
    assert main_text(PAGE.format(f"<div><p>{long}</p><p>Short end.</p></div>")) == f"{long.strip()}\nShort end."


def test_html_closes_elements_at_any_depth():
    long = "the quick of and to in a brown fox " * 8
    menu = "<nav>" + "<p><b><i>Menu" * 300 + "</nav>"
    assert main_text(f"{menu}<p>{long}</p>") == long.strip()
    assert main_text("<div class=advert>" + "<font>x" * 300 + f"</div><p>{long}</p>") == long.strip()
    assert main_text(f"<article><p>{long}" + "<span>" * 300 + f"</article><p>{long}</p>") == long.strip()


def test_html_keeps_text_outside_a_teaser():
    long = "the quick of and to in a brown fox " * 8
    assert main_text(f"<article>Read more</article><div><p>{long}</p></div>") == f"Read more\n{long.strip()}"
    assert main_text(f"<article><p>{long}</p></article><div><p>{long}</p></div>") == long.strip()


def test_sketch_is_lossless():
    r = random.Random(7)
    for _ in range(300):
        own = np.unique(np.array([r.getrandbits(60) for _ in range(r.randint(1, 60))], np.uint64))
        lost = r.sample(range(len(own)), int(0.2 * len(own)))
        rest = set(np.delete(own, lost).tolist())
        assert rest & set(decontaminate.sketch(own, 0.8).tolist())


def test_decontamination_search():
    item = "one two three four five six seven eight nine ten eleven twelve"
    search = decontaminate.Searcher(decontaminate.ItemIndex.of([(1, item), (2, "only three words"), (3, None), (4, "...")], 5, 0.8))
    assert [x[0] for x in search.find(f"Start. {item.upper()}, and only three, words at the end")] == [1, 2]
    assert search.find(None) == search.find("one two three four five") == []


def test_toxicity_learns_and_forgets_identity():
    r = random.Random(1)
    filler = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        words = [r.choice(filler) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[3] = "vile"
        if (bad and i % 8 == 0) or i % 50 == 1:
            words[5] = "muslims"
        rows.append((" ".join(words), int(bad)))
    plain = toxicity.fit_toxicity(rows, toxicity.ToxicityFit(counterfactual=0.0))
    fair = toxicity.fit_toxicity(rows, toxicity.ToxicityFit(counterfactual=10.0))
    assert fair.score("vile thing") >= 0.7 > fair.score("a thing")
    gap = lambda m: abs(m.score("w1 muslims w2") - m.score("w1 people w2"))
    assert gap(fair) < 0.3 * gap(plain)
    assert 0 <= fair.score(None) <= 1 and fair.score("") == fair.score(None)
    assert toxicity.fit_toxicity([]).score("x") == 0.5 and toxicity.fit_toxicity([("a", 0)] * 9).score("x") < 0.5


def test_toxicity_weighs_every_sure_word():
    bad = [f"bad{i}" for i in range(400)]
    rows = [(f"{w} t{w}x{i}", 1) for w in bad for i in range(40)] + [(f"good{i % 400} u{i}", 0) for i in range(16000)]
    model = toxicity.fit_toxicity(rows)
    assert set(model.weights) >= {w.encode() for w in bad} and all(model.score(w) > 0.7 for w in bad)
    assert all(model.score(f"good{i}") < 0.3 for i in range(400))


def test_features_of_resampling():
    how, h = resample.Resampling(), WordHashes()
    assert len(resample.feature_buckets("a b!! c", how, h)) == 4 + 3
    assert len(resample.feature_buckets(None, how, h)) == len(resample.feature_buckets(" ", how, h)) == 0
