"""Memory that Python workers keep from task to task, and the shuffles and passes that tasks don't need."""

import os
import sys

import numpy as np
import pyarrow as pa
import pytest

from refloom.llm import linededup, text, tokens


def test_workers_drop_what_other_tasks_kept(spark):
    def keep(batches):
        text.kept("probe", lambda: [0])
        yield from batches

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid() + 0 * sum(batch.column(0).to_pylist())]), pa.array([len(text._KEPT)])], names=["pid", "n"])

    def counted(run):
        return {r.pid: r.n for r in spark.range(0, 4, 1, 4).mapInArrow(run, "pid long, n long").collect()}

    for keeps, others in ((True, {1}), (False, {0})):
        for _ in range(3):  # a task may get a new worker
            kept = {r.id for r in spark.range(0, 4, 1, 4).mapInArrow(text.lean(keep, keeps=True), "id long").collect()}
            found = counted(text.lean(count, keeps=keeps))
            assert kept == {0, 1, 2, 3}
        if others == {0}:
            assert set(found.values()) == {0}
        else:
            assert 1 in found.values()


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_task_gives_free_memory_back():
    def held():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    def run(batches):
        some = [bytes(2000) for _ in range(100_000)]
        last = bytes(100)  # stands after what is free then
        del some
        yield last

    before = held()
    assert len(list(text.lean(run)(iter(())))) == 1 and held() - before < 60_000_000


def test_texts_are_cut_where_kinds_of_signs_change():
    encoder = tokens.CachedEncoder(tokens.default_tokenizer())
    texts = ["word, word (x2), don't; it's.", "naïve, é. 'tis a's", "", "a1b2 c--d\n\n e", "..'s ''ll x'd"]
    ids, counts = (np.concatenate(x) for x in zip(*encoder.encode(pa.array(texts))))
    assert {b"word", b",", b" word", b" (", b"x", b"2"} <= set(encoder.chunks.known) and b"word," not in encoder.chunks.known
    assert b"word" not in encoder.pieces.known
    for own, n in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert n.tolist() == encoder.tokenizer.encode(own, add_special_tokens=False).ids


def test_owners_of_runs_are_found_without_sorting_where_ids_are_unique(spark, capsys):
    rows = [(i, 100 - i, run) for i in range(-3, 9) for run in {i % 3, i % 5, 7 * i}]
    runs = spark.createDataFrame(rows, "id long, h long, run long")
    fast, slow = (linededup._owners(runs, own) for own in (True, False))
    assert sorted(fast.collect()) == sorted(slow.collect()) != []
    fast.explain()
    assert "SortAggregate" not in capsys.readouterr().out
    fast = linededup._distinct(np.array([3, 1, 3, 0, 1, 3]), 5)
    assert [x.tolist() for x in fast] == [x.tolist() for x in np.unique([3, 1, 3, 0, 1, 3], return_index=True, return_counts=True)]


def test_places_of_cuts_are_looked_at_one_by_one_only_after_characters_beyond_ascii(monkeypatch):
    looked, no_space = [], tokens._no_space
    monkeypatch.setattr(tokens, "_no_space", lambda data, at, last: looked.append(len(at)) or no_space(data, at, last))
    encoder = tokens.CachedEncoder(tokens.default_tokenizer())
    monkeypatch.setattr(encoder, "_learn_cut", lambda chunks: encoder._wholes([c.decode() for c in chunks.to_pylist()]))
    texts = ["plain words, 12 of them " * 40, "é a\nà b ü　c  d", "", "x", " ", "a\n", "don't  stop\tnow é", "  x", "日本 語 text"]
    ids, counts = next(encoder.encode(pa.array(texts, pa.large_string())))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert sum(looked) <= 8


def test_targets_are_whole_quotients_and_places_take_32_bits():
    from refloom.llm import idcodec

    r = np.random.Generator(np.random.PCG64(1))
    ids = r.integers(0, 50, 3000, np.uint32)
    model, blocks = idcodec.encode_group(ids)
    coder = idcodec._Decoder(idcodec.Model.load(model), [b for _, b in blocks])
    assert coder.one.dtype == coder.two.dtype == np.int32
    for _ in range(300):
        n = coder.n
        coder.range = r.integers(1 << 20, 1 << 64, n, np.uint64) >> r.integers(0, 40, n, np.uint64) | np.uint64(1 << 20)
        unit, goal = coder.range >> np.uint64(16), r.integers(0, 1 << 16, n, np.uint64)
        above = goal * unit + r.choice(np.array([0, 1], np.uint64), n) * (unit - np.uint64(1))  # just at and just below the next
        coder.low = r.integers(0, 1 << 64, n, np.uint64)
        coder.code = coder.low + above
        assert coder.target().tolist() == goal.tolist()


def test_only_lanes_with_a_guess_are_mixed_and_intervals_are_found_from_their_parts():
    from refloom.llm import idcodec

    r = np.random.Generator(np.random.PCG64(2))
    ids = np.minimum(r.zipf(1.3, 40_000), 60_000).astype(np.uint32)
    lengths = idcodec.block_lengths(len(ids))
    model, places, _ = idcodec._fitted(ids, lengths)
    coder, column = idcodec._Encoder(model, len(lengths)), np.cumsum(lengths) - lengths
    for t in range(int(lengths[-1])):
        coder.guess()
        own = places[column + t].astype(np.int32)
        assert len(coder.has) == len(coder.guessed) == len(coder.mine) < coder.n
        coder.learn(own, coder.guessed == own[coder.has])
    assert t > 200 and len(coder.has)
    decoder = idcodec._Decoder(model, [b""] * 3)
    row, goal = r.integers(0, model.n + 1, 20_000), r.integers(0, 1 << 16, 20_000)
    goal[:4000] = r.choice(np.array([0, (1 << 16) - 1]), 4000)
    keys = (np.repeat(np.arange(model.n + 1), np.diff(model.escape_at, prepend=-1)) << 16) + model.start
    assert decoder.interval_of(row, goal).tolist() == (np.searchsorted(keys, (row << 16) + goal, "right") - 1).tolist()
    whole, coded = idcodec.encode_group(ids)
    assert (np.concatenate(idcodec.decode_group(whole, [c for _, c in coded], len(ids))) == ids).all()


def test_words_with_latin_letters_or_after_a_line_end_take_no_pattern(monkeypatch):
    encoder, cut = tokens.CachedEncoder(tokens.default_tokenizer()), []
    learn_cut = encoder._learn_cut
    monkeypatch.setattr(encoder, "_learn_cut", lambda chunks: cut.extend(chunks.to_pylist()) or learn_cut(chunks))
    texts = ["Über naïve\nÉté\nwords\n12\n,; à", "3×4 a÷b é1 1é é's don't x y", "\n", "\n\nw", "\nw", " \nÿ", "w\n", "ÀÖØöøÿ ×÷", "日é\nж é日", "é́ e"]
    ids, counts = next(encoder.encode(pa.array(texts, pa.large_string())))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert {"Über".encode(), " naïve".encode(), "\nÉté".encode(), b"\nwords", b"\n12", b"\n,;"} <= set(encoder.chunks.known) - set(cut)
    assert {" é1".encode(), b"\n"} <= set(cut)
