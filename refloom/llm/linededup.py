"""Line deduplication by pairwise alignment.

Documents that overlap are found through rare hashes of runs of words: at each line the shortest run of lines with
min_words words (a short line alone is common, such a run is rare) and, for passages that begin or end within a line or
are wrapped otherwise, windows of min_words words, of which every WINDOW consecutive ones have one that is chosen by its
hash alone; so no common run of min_words + WINDOW - 1 words stays unseen, wherever its lines end. Each hash belongs to
the first document that has it, and every later document with it is aligned with that owner only: so there are at most
as many pairs as hashes, whatever the number of copies. Pairs are aligned by patience diff over their windows of min_words
words, and the aligned common blocks are deleted from the later document, as are runs of twice as many words that the
alignment passes over since they are moved or repeated. A later document with an earlier one's text is deleted whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from refloom.llm.shared import free_names, materialize
from refloom.llm.text import lean, rows_of

MIN_WORDS = 20
#: Windows of words of which one at least is met by its hash.
WINDOW = 21
#: Words of a line at a block's end that stay if they are fewer and the block reaches past that line's end.
EDGE = 5

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a factor and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for i, factor in enumerate((_BASE, _INVERSE)):
            many = np.full(2 * n, factor, np.uint64)
            many[0] = 1
            _POWERS[i] = np.multiply.accumulate(many)
    return _POWERS[0][:n], _POWERS[1][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes of values[start:end] for each start and end; values are 64-bit integers."""
    power, inverse = _powers(len(values) + 1)
    mixed = values.astype(np.uint64)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((mixed ^ mixed >> np.uint64(32)) * power[:-1], out=sums[1:])
    found = (sums[ends] - sums[starts]) * inverse[starts]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0x94D049BB133111EB)
    return (found ^ found >> np.uint64(29)).view(np.int64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def meeting_hashes(words: np.ndarray, documents: np.ndarray, lines: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes by which documents are met, and the document of each: of their runs of lines, and of some of their windows of words.

    words: hashes of all words of the documents, one document after the other; documents and lines: where each document,
    and each line that has a word, begins, and at the end the number of words. Hashes are distinct in a document.
    """
    of = np.repeat(np.arange(len(documents) - 1), np.diff(documents))
    starts = lines[:-1]
    ends = np.searchsorted(lines, starts + min_words)
    whole = ends < len(lines)
    starts, ends = starts[whole], lines[ends[whole]]
    inside = of[starts] == of[ends - 1]
    starts, ends = starts[inside], ends[inside]
    found, owner = [run_hashes(words, starts, ends)], [of[starts]]
    many = len(words) - min_words + 1
    if many > 0:
        at = np.arange(many)
        windows, alone = run_hashes(words, at, at + min_words), of[at] == of[at + min_words - 1]
        # each least hash of WINDOW windows of one document
        if many >= WINDOW:
            least = _least(windows, WINDOW)
            own = of[: len(least)]
            ok = own == of[np.arange(len(least)) + WINDOW + min_words - 2]
            found.append(least[ok])
            owner.append(own[ok])
        # and the least of all of a document that has fewer
        per = np.bincount(of[at[alone]], minlength=len(documents) - 1)
        few = np.flatnonzero((per > 0) & (per < WINDOW))
        if len(few):
            bounds = np.stack((documents[few], documents[few] + per[few]), axis=1).ravel()
            found.append(np.minimum.reduceat(np.append(windows, windows[-1:]), bounds)[::2])
            owner.append(few)
    hashes, owners = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[first], owners[first]


def _chain(begins: np.ndarray, weights: np.ndarray) -> list[int]:
    """Positions of a chain of ascending begins (all different) with the largest sum of weights; of equal sums, the chain whose members begin least, from its end on."""
    n = len(begins)
    if n == 1:
        return [0]
    rank = np.empty(n, np.int64)
    rank[np.argsort(begins)] = np.arange(1, n + 1)
    best: list[tuple[int, int, int]] = [(0, 0, -1)] * (n + 1)  # a tree of prefix maxima over ranks: sum, -rank, position
    before = []
    for k, (r, w) in enumerate(zip(rank.tolist(), weights.tolist(), strict=True)):
        found, i = (0, 0, -1), r - 1
        while i > 0:
            found = max(found, best[i])
            i &= i - 1
        before.append(found[2])
        own, i = (found[0] + w, -r, k), r
        while i <= n:
            best[i] = max(best[i], own)
            i += i & -i
    found, i = (0, 0, -1), n
    while i > 0:
        found = max(found, best[i])
        i &= i - 1
    k, out = found[2], []
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _places(sought: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each of sought stands in known, which is sorted and not empty; -1 where it doesn't."""
    at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
    return np.where(known[at] == sought, at, -1)


def _distinct(values: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the first place of each and how often it occurs; values are from 0 to many - 1. Without sorting where these are few enough."""
    if many > 4 * len(values):
        return np.unique(values, return_index=True, return_counts=True)
    times, first = np.bincount(values, minlength=many), np.empty(many, np.int64)
    first[values[::-1]] = np.arange(len(values) - 1, -1, -1)  # of equal indices the last one counts
    found = np.flatnonzero(times)
    return found, first[found], times[found]


def patience_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Patience diff: (from in a, from in b, length) of runs that are aligned, ascending in both. Negative numbers of a stand nowhere in b.

    What both ranges begin and end with is aligned; then numbers that occur once in each are anchors, of which a largest
    ascending set is aligned, and the ranges between its runs are worked on in the same way. Where no number occurs once
    in each, the first of a that b has is aligned with its first place in b.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    many = 1 + max(int(a.max(initial=-1)), int(b.max(initial=-1)))
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        for back in (False, True):
            n = min(ahi - alo, bhi - blo)
            if n <= 0:
                break
            x, y = (a[ahi - n : ahi][::-1], b[bhi - n : bhi][::-1]) if back else (a[alo : alo + n], b[blo : blo + n])
            differ = np.flatnonzero(x != y)
            same = int(differ[0]) if len(differ) else n
            if same and back:
                ahi, bhi = ahi - same, bhi - same
                found.append((ahi, bhi, same))
            elif same:
                found.append((alo, blo, same))
                alo, blo = alo + same, blo + same
        if alo >= ahi or blo >= bhi:
            continue
        place = alo + np.flatnonzero(a[alo:ahi] >= 0)
        if not len(place):
            continue
        values, first, times = _distinct(a[place], many)
        others, other_first, other_times = _distinct(b[blo:bhi], many)
        j = _places(values, others)
        i = np.flatnonzero(j >= 0)
        if not len(i):
            continue
        j = j[i]
        at, there = place[first[i]], blo + other_first[j]
        once = (times[i] == 1) & (other_times[j] == 1)
        if not once.any():
            k = int(np.argmin(at))
            todo.append((int(at[k]), ahi, int(there[k]), bhi))
            continue
        order = np.argsort(at[once])
        at, there = at[once][order], there[once][order]
        begins = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(there) != 1))))
        lengths = np.diff(np.append(begins, len(at)))
        for k in _chain(there[begins], lengths):
            i, j, n = int(at[begins[k]]), int(there[begins[k]]), int(lengths[k])
            found.append((i, j, n))
            todo.append((alo, i, blo, j))
            alo, blo = i + n, j + n
        todo.append((alo, ahi, blo, bhi))
    return sorted(found)


def _any_in(some: np.ndarray, words: np.ndarray) -> bool:
    """Whether any of some is among words; 16-bit numbers are looked up in a table."""
    if words.dtype != np.uint16 or some.dtype != np.uint16:
        return bool(np.isin(some, words).any())
    table = np.zeros(1 << 16, bool)
    table[words] = True
    return bool(table[some].any())


def common_words(a: np.ndarray, b: np.ndarray, min_words: int = MIN_WORDS, moved: int | None = None) -> list[tuple[int, int]]:
    """Ranges [from, to) of the words of a that stand in b as a run too.

    The windows of min_words words of a and b are aligned by patience diff, and the words of aligned windows are common:
    so a run of min_words words counts where it stands in b in the order of the alignment. A run that the alignment
    passes over, as it is moved or repeated, counts if it has `moved` words (two times min_words unless given).
    """
    moved = 2 * min_words if moved is None else moved
    shorter = min(len(a), len(b))
    if shorter < min_words:
        return []
    if len(a) == len(b) and (a == b).all():
        return [(0, len(a))]
    # windows of what both begin and end with are aligned; the others need the words of no more than these and their neighbours
    differ = np.flatnonzero(a[:shorter] != b[:shorter])
    head = max(0, (int(differ[0]) if len(differ) else shorter) - min_words + 1)
    differ = np.flatnonzero(a[len(a) - shorter :] != b[len(b) - shorter :])
    tail = max(0, (shorter - 1 - int(differ[-1]) if len(differ) else shorter) - min_words + 1)
    tail = min(tail, shorter - min_words + 1 - head)
    ranges = ([(0, head + min_words - 1)] if head else []) + ([(len(a) - tail - min_words + 1, len(a))] if tail else [])
    middle_a, middle_b = a[head : len(a) - tail], b[head : len(b) - tail]
    if min(len(middle_a), len(middle_b)) >= min_words:
        of_a, of_b = (run_hashes(x, at := np.arange(len(x) - min_words + 1), at + min_words) for x in (middle_a, middle_b))
        known, numbers_b = np.unique(of_b, return_inverse=True)
        numbers_a = _places(of_a, known)
        if (numbers_a >= 0).any():
            ranges += [(head + i, head + i + n - 1 + min_words) for i, _, n in patience_blocks(numbers_a, numbers_b)]
    left = np.ones(len(a), bool)
    for lo, hi in ranges:
        left[lo:hi] = False
    # a run that is moved has a word that is left, and b has that word
    if len(middle_a) >= moved and len(b) >= moved and _any_in(a[left], b):
        longer_a, longer_b = (run_hashes(x, at := np.arange(len(x) - moved + 1), at + moved) for x in (middle_a, b))
        ranges += [(head + i, head + i + moved) for i in np.flatnonzero(_places(longer_a, np.sort(longer_b)) >= 0).tolist()]
    found: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if found and lo <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], hi))
        else:
            found.append((lo, hi))
    return found


def _without(line: bytes, dead: list[bool]) -> bytes:
    """A line without its dead words: each stretch of them goes with the white space after it, at the line's end with that before."""
    parts, start, at, before = [], 0, 0, False
    for word, own in zip(line.split(), dead, strict=True):
        place = line.index(word, at)
        if own and not before:
            parts.append(line[start:place])
        elif before and not own:
            start = place
        at, before = place + len(word), own
    return b"".join(parts).rstrip() if before else b"".join([*parts, line[start:]])


def delete_words(text: str | None, ranges: Sequence[tuple[int, int]], min_words: int = MIN_WORDS) -> tuple[str | None, int, int, int]:
    """What is left of a text without the ranges of words, and its numbers of lines with a word, of such lines deleted, and of words deleted.

    A block that reaches less than EDGE words into a line, past that line's beginning or end, ends with the line before
    (or begins with the one after) unless it would fall short of min_words. A line that loses all its words goes;
    another loses the words and the white space before the next word that stays. Other lines stay as they are.
    """
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    if not ranges:
        return text, sum(not line.isspace() and line != b"" for line in lines), 0, 0
    counts = [len(line.split()) for line in lines]
    if any(lo <= 0 and hi >= sum(counts) for lo, hi in ranges):
        n_lines = sum(c > 0 for c in counts)
        return b"\n".join(line for line, c in zip(lines, counts, strict=True) if not c).decode("utf-8", "surrogatepass"), n_lines, n_lines, sum(counts)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    n_lines = sum(c > 0 for c in counts)
    gone = np.zeros(int(bounds[-1]) + 1, bool)
    for lo, hi in ranges:
        gone[lo:hi] = True
    if not gone.any():
        return text, n_lines, 0, 0
    change = np.flatnonzero(np.diff(gone, prepend=False))
    for lo, hi in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        before, after = (int(bounds[np.searchsorted(bounds, x, "left")]) for x in (lo, hi))  # the line's end at or after each bound
        first = before if lo < before < hi and before - lo < EDGE else lo
        start = int(bounds[np.searchsorted(bounds, hi, "right") - 1])  # the start of the line that the block ends in
        last = start if lo < start < hi < after and hi - start < EDGE else hi
        if last - first >= min_words:
            gone[lo:first] = gone[last:hi] = False
    out, deleted = [], 0
    for k, line in enumerate(lines):
        own = gone[bounds[k] : bounds[k + 1]]
        if not len(own) or not own.any():
            out.append(line)
        elif own.all():
            deleted += 1
        else:
            out.append(_without(line, own.tolist()))
    return b"\n".join(out).decode("utf-8", "surrogatepass"), n_lines, deleted, int(gone.sum())


_NO_ID = -(1 << 63)


#: Bytes that part words, and a fixed random number for each byte.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_NUMBERS = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
#: Bytes whose prefix sums are in memory at a time.
_BYTES = 1 << 18


def byte_run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for ranges of bytes in order that don't overlap."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + _BYTES, "right")), i + 1)
        first, last = int(starts[i]), int(ends[j - 1])
        if last - first > 4 * _BYTES:  # one word, longer than all others: piece by piece
            pieces = np.arange(first, last, _BYTES)
            out[i] = run_hashes(byte_run_hashes(data, pieces, np.append(pieces[1:], last)), np.array([0]), np.array([len(pieces)])).view(np.uint64)[0]
        else:
            power, inverse = _powers(last - first + 1)
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum(_NUMBERS[data[first:last]] * power[:-1], out=sums[1:])
            found = (sums[ends[i:j] - first] - sums[starts[i:j] - first]) * inverse[starts[i:j] - first]
            found ^= found >> np.uint64(32)
            found *= np.uint64(0xBF58476D1CE4E5B9)
            out[i:j] = found ^ found >> np.uint64(29)
        i = j
    return out


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, documents, lines) of texts data[offsets[k]:offsets[k + 1]], in UTF-8: as meeting_hashes takes them."""
    inside = ~_SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[0] = after[-1] = False
        borders = offsets[(offsets > 0) & (offsets < len(data))]
        before[borders] = after[borders - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    documents = np.searchsorted(starts, offsets)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    begins = np.ones(len(starts), bool)
    begins[1:] = line[1:] != line[:-1]
    begins[documents[:-1][documents[:-1] < len(starts)]] = True
    return byte_run_hashes(data, starts, ends), documents, np.append(np.flatnonzero(begins), len(starts))


def _slices(texts: pa.StringArray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, begin, end): texts in slices of about most bytes, one text at least. A null text is empty."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1, begin + 1)
        yield data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], begin, end
        begin = end


def _blobs(words: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The two upper bytes of each word's hash, as one binary value a document: they tell words apart well enough, as a block takes min_words of them."""
    data = (words >> np.uint64(48)).astype("<u2").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((2 * bounds).astype(np.int32).tobytes()), pa.py_buffer(data)])


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The values of a column of _blobs, as arrays."""
    return (np.frombuffer(x.as_buffer(), "<u2") for x in column)


def _owners(runs: DataFrame, own_ids: bool) -> DataFrame:
    """(run2, oid, oh): the first document of each run (id, h, run) that several have. own_ids: whether no two texts have one id, so that numbers alone are compared, which takes no sorting."""
    by_run = runs.groupBy(F.col("run").alias("run2"))
    if own_ids:
        return by_run.agg(F.min("id").alias("oid"), F.min_by("h", "id").alias("oh"), F.max("id").alias("last")).where("oid != last").drop("last")
    found = by_run.agg(F.min(F.struct("id", "h")).alias("o"), F.max(F.struct("id", "h")).alias("last")).where("o != last")
    return found.select("run2", F.col("o.id").alias("oid"), F.col("o.h").alias("oh"))


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, lo, hi): ranges of words to delete from the document with that id and text hash; ranges may overlap.

    Documents are in the order of doc_id (null first), of equal ids in that of their text's hash; rows with equal id
    and text are one document. A doc_id that is no whole number is refused with TypeError.
    """
    if not isinstance(docs.schema["doc_id"].dataType, (IntegralType, NullType)):
        raise TypeError("doc_id must be of a whole-number type: it says which document is the later one")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for data, offsets, begin, end in _slices(texts if texts.type == pa.string() else texts.cast(pa.string())):
                words, documents, lines = cut_words(data, offsets)
                found, owners = meeting_hashes(words, documents, lines, min_words)
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(end - begin + 1)).astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), _blobs(words, documents), runs], names=["id", "h", "words", "runs"])

    cut_up = materialize(rows.mapInArrow(lean(cut), "id long, h long, words binary, runs array<long>"), "lines")
    runs = cut_up.select("id", "h", F.explode("runs").alias("run"))
    owners = materialize(_owners(runs, cut_up.groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").isEmpty()), "line-owners")
    # owners grow with the documents, so they are never broadcast: one plan at every size. A run has one owner, so their side
    # of a partition is never larger than its share
    pairs = materialize(runs.join(owners.hint("shuffle_hash"), F.col("run") == F.col("run2")).where("id != oid or h != oh").select("id", "h", "oid", "oh").distinct(), "line-pairs")
    # a copy of an earlier text goes whole, and needs no other alignment
    copies = cut_up.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last").select(F.col("h").alias("ch"), "first")
    copies = materialize(copies, "line-copies")
    whole = cut_up.select("id", "h", (F.octet_length("words") / 2).cast("int").alias("n")).where(F.col("n") >= min_words).join(copies.hint("merge"), F.col("h") == F.col("ch")).where("id != first")
    rest = materialize(pairs.join(copies.hint("merge"), F.col("h") == F.col("ch"), "left").where("first is null or id = first").select("id", "h", "oid", "oh"), "line-pairs-to-align")
    # the owners' and the later documents' words are joined on; rows with equal id and text are one document
    own = cut_up.select(F.col("id").alias("oid2"), F.col("h").alias("oh2"), F.col("words").alias("owner_words")).dropDuplicates(["oid2", "oh2"])
    own = own.join(rest.select("oid", "oh").distinct().hint("merge"), (F.col("oid2") == F.col("oid")) & (F.col("oh2") == F.col("oh")), "left_semi")
    later = cut_up.select(F.col("id").alias("i2"), F.col("h").alias("h2"), "words").dropDuplicates(["i2", "h2"])
    joined = rest.join(own.hint("merge"), (F.col("oid") == F.col("oid2")) & (F.col("oh") == F.col("oh2"))).select("id", "h", "owner_words")
    joined = joined.join(later.hint("merge"), (F.col("id") == F.col("i2")) & (F.col("h") == F.col("h2"))).select("id", "h", "words", "owner_words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (batch.column(batch.schema.get_field_index(n)) for n in ("words", "owner_words"))
            pairs = zip(rows_of(batch, "id", "h"), _arrays(own), _arrays(other), strict=True)
            out = [(i, h, lo, hi) for (i, h), a, b in pairs for lo, hi in common_words(a, b, min_words)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["id", "h", "lo", "hi"])

    aligned = joined.mapInArrow(lean(align), "id long, h long, lo int, hi int")
    return aligned.unionByName(whole.select("id", "h", F.lit(0).alias("lo"), F.col("n").alias("hi")))


def dedup_lines(docs: DataFrame, keep: Sequence[str] = ("doc_id",), min_words: int = MIN_WORDS) -> DataFrame:
    """keep of every row of docs, with text (what is left), n_lines (with a word), n_deleted (of these, all words) and words_deleted.

    Documents without a common block, null texts and empty ones stay as they are; a copy of an earlier document loses
    all; an empty table gives an empty one; other columns play no part; a kept column that is named like a new one is
    called input_<name>.
    """
    keep = list(keep)
    names = free_names(keep, ["text", "n_lines", "n_deleted", "words_deleted"])
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("__id"), F.xxhash64("text").alias("__h"), F.col("text").cast("string").alias("text"))
    ranges = deletions(docs, min_words).groupBy("id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    # the ranges grow with the documents, so they are never broadcast: one plan at every size
    joined = rows.join(materialize(ranges, "line-ranges").hint("merge"), (F.col("__id") == F.col("id")) & (F.col("__h") == F.col("h")), "left")
    joined = joined.select(*(f"c{i}" for i in range(len(keep))), "text", F.col("ranges.lo").alias("lo"), F.col("ranges.hi").alias("hi"))
    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "text string, n_lines long, n_deleted long, words_deleted long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [delete_words(text, list(zip(lo or (), hi or ())), min_words) for text, lo, hi in rows_of(batch, "text", "lo", "hi")]
            texts, *counts = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=[*(f"c{i}" for i in range(len(keep))), "text", "n_lines", "n_deleted", "words_deleted"])

    found = joined.mapInArrow(lean(run), schema)
    return found.select(*(F.col(f"c{i}").alias(names[c]) for i, c in enumerate(keep)), "text", "n_lines", "n_deleted", "words_deleted")


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
