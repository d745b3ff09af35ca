"""Adaptive context-mixing range coder for token ids.

Ids are coded by groups of up to GROUP. A group's model holds its distinct ids, in ascending order, and what is known of
them before coding starts: order 1, for each id the frequencies of the ids that follow it often, and order 0, the
frequencies of the ids that order 1 leaves out. The group is cut into blocks of up to BLOCK ids; each is coded from this
same state, so blocks stand alone.

In a block, order 2 (the two ids before) predicts the id that last followed them there. Whether it is right is a binary
event; its probability comes from logistic mixing of what order 2 (by how often its guess held) and order 1 (by how sure
it is after the id before) say of it, with rates and weights that learn from each event. An id that order 2 doesn't give
is coded by order 1, and one that order 1 doesn't have, after an escape, by order 0. All probabilities are integers, so
encoder and decoder agree on any machine.

The blocks of a group go through the coder in step, one NumPy lane each: a Python loop over ids would be some hundred
times slower. Lanes don't influence each other, so a block's bytes don't depend on its neighbours'.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

BLOCK = 1024
GROUP = 1 << 23
_SLOTS = 256  # of order 2's table in a lane
_PART = 1 << 16  # ids that a pass takes at a time where several follow each other
_LEAST = 3  # an id that follows another less often in a group is left to order 0
_ONE = 1 << 16  # total of order 1's frequencies after an id
_FULL = np.uint64((1 << 64) - 1)
_16, _32, _LOW, _TOTAL = np.uint64(16), np.uint64(32), np.uint64((1 << 32) - 1), np.uint64(_ONE)
_HEAD = struct.Struct("<IIIB")


def _squash_table() -> np.ndarray:
    """Probability (of 4096) of log-odds from -2047 to 2047 in 1/256."""
    x = np.arange(-2048, 2048)
    return (4096 / (1 + np.exp(-x / 256))).round().clip(1, 4095).astype(np.int32)


_SQUASH = _squash_table()
_STRETCH = (np.searchsorted(_SQUASH, np.arange(4096)) - 2048).clip(-2047, 2047).astype(np.int32)


def block_lengths(n: int) -> np.ndarray:
    """How n ids are cut into blocks: lengths that differ by one at most, the longer ones first; few ids make short blocks, so that they go in step too."""
    lanes = max(-(-n // BLOCK), min(64, -(-n // 256)))
    return np.full(lanes, n // lanes, np.int64) + (np.arange(lanes) < n % lanes) if lanes else np.zeros(0, np.int64)


def _packed(values: np.ndarray, dtype: str) -> bytes:
    """Whole numbers, byte plane after byte plane."""
    raw = np.ascontiguousarray(values, dtype)
    return raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()


def _unpacked(data: bytes, n: int, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(dtype).reshape(n).astype(np.int64)


class Model:
    """A group's ids and their frequencies.

    ids: the distinct ids, ascending; below, an id is its place among them, and len(ids) stands for none. Row c of order
    1 holds the ids that follow id c and their frequencies (of 65536), ended by the escape; total of order 0: 2 ** bits.
    """

    def __init__(self, ids: np.ndarray, row: np.ndarray, follower: np.ndarray, frequency: np.ndarray, rare: np.ndarray, bits: int):
        self.ids, self.row, self.follower, self.frequency, self.rare, self.bits = ids, row, follower, frequency, rare, bits
        k = self.n = len(ids)
        lengths = np.bincount(row, minlength=k + 1)
        own = np.concatenate(([0], np.cumsum(frequency)))
        ends = np.cumsum(lengths)
        base = own[ends - lengths]
        escape = own[ends] - base  # where a row's escape starts
        place = np.arange(len(row)) + row
        self.start = np.empty(len(row) + k + 1, np.int32)
        self.start[place] = own[:-1] - base[row]
        self.start[ends + np.arange(k + 1)] = escape
        self.size = np.empty_like(self.start)
        self.size[place] = frequency
        self.size[ends + np.arange(k + 1)] = _ONE - escape
        self.symbol = np.full(len(self.start), k, np.int32)
        self.symbol[place] = follower
        self.escape_start, self.escape_at = escape, ends + np.arange(k + 1)
        self.rare_start = np.concatenate(([0], np.cumsum(rare)))
        # how sure order 1 is after an id, in four steps: by its greatest frequency
        top = np.zeros(k + 1, np.int64)
        np.maximum.at(top, row, frequency)
        self.sure4 = np.searchsorted([_ONE // 16, _ONE // 4, _ONE // 2], top, "right") + 4

    def dump(self) -> bytes:
        gaps = np.diff(self.ids, prepend=0)
        after = np.diff(self.follower, prepend=0) * (np.diff(self.row, prepend=-1) == 0) + self.follower * (np.diff(self.row, prepend=-1) != 0)
        lengths = np.bincount(self.row, minlength=self.n + 1)
        body = _packed(gaps, "<u4") + _packed(lengths, "<u4") + _packed(after, "<u4") + _packed(self.frequency, "<u4") + _packed(self.rare, "<u4")
        return _HEAD.pack(self.n, len(self.row), zlib.crc32(body), self.bits) + zlib.compress(body)

    @staticmethod
    def load(data: bytes) -> Model:
        n, pairs, crc, bits = _HEAD.unpack_from(data)
        try:
            body = zlib.decompress(data[_HEAD.size :])
        except zlib.error as why:
            raise ValueError("a group's model is damaged") from why
        if zlib.crc32(body) != crc:
            raise ValueError("a group's model doesn't fit its checksum")
        parts, at = [], 0
        for size in (n, n + 1, pairs, pairs, n):
            parts.append(_unpacked(body[at : at + 4 * size], size, "<u4"))
            at += 4 * size
        gaps, lengths, after, frequency, rare = parts
        row = np.repeat(np.arange(n + 1), lengths)
        ends = np.cumsum(lengths)
        sums = np.concatenate(([0], np.cumsum(after)))
        follower = sums[1:] - np.repeat(sums[ends - lengths], lengths)
        return Model(np.cumsum(gaps), row, follower, frequency, rare, bits)


def _fitted(ids: np.ndarray, lengths: np.ndarray) -> tuple[Model, np.ndarray, np.ndarray]:
    """A group's model, the places of its ids, and for each id where order 1 has it, or the escape before it."""
    n, most = len(ids), int(ids.max())
    if most < 1 << 24:
        seen = np.zeros(most + 1, bool)
        for a in range(0, n, _PART):
            seen[ids[a : a + _PART]] = True
        distinct = np.flatnonzero(seen)
        place_of = np.zeros(most + 1, np.int32)
        place_of[distinct] = np.arange(len(distinct), dtype=np.int32)
        places = np.empty(n, np.int32)
        for a in range(0, n, _PART):
            places[a : a + _PART] = place_of[ids[a : a + _PART]]
    else:
        distinct, places = np.unique(ids, return_inverse=True)
    k = len(distinct)
    # pairs of neighbours in order, each with its position in the low bits
    shift = np.uint64(max(n - 1, 1).bit_length())
    keys = np.empty(n, np.uint64)
    keys[1:] = places[:-1]
    keys[np.cumsum(lengths) - lengths] = k
    for a in range(0, n, _PART):  # within the processor's caches
        some = keys[a : a + _PART]
        some *= np.uint64(k + 1)
        some += places[a : a + _PART].astype(np.uint64)
        some <<= shift
        some |= np.arange(a, a + len(some), dtype=np.uint64)
    keys.sort()
    at, new, low = np.empty(n, np.int32), np.ones(n, bool), (np.uint64(1) << shift) - np.uint64(1)
    for a in range(0, n, _PART):
        some = keys[a : a + _PART]
        at[a : a + _PART] = some & low
        some >>= shift
        np.not_equal(keys[max(a, 1) : a + len(some)], keys[max(a, 1) - 1 : a + len(some) - 1], out=new[max(a, 1) : a + len(some)])
    first = np.flatnonzero(new)
    count = np.diff(first, append=n)
    pair = keys[first].astype(np.int64)
    del keys, some, new
    row = pair // (k + 1)
    follower = pair - row * (k + 1)
    del pair
    seen = np.bincount(row, count, minlength=k + 1).astype(np.int64)
    kept = (count >= _LEAST) & (row < k)
    m = np.bincount(row[kept], minlength=k + 1)
    kept &= (m < _ONE // 2)[row]
    m = np.bincount(row[kept], minlength=k + 1)
    frequency = 1 + count[kept] * (_ONE - 1 - m[row[kept]]) // seen[row[kept]]
    left = np.bincount(follower[~kept], count[~kept], minlength=k).astype(np.int64)
    bits = max(16, int(np.count_nonzero(left)).bit_length() + 2)
    spare = (1 << bits) - int(np.count_nonzero(left))
    rare = np.where(left > 0, 1 + left * spare // max(int(left.sum()), 1), 0)
    model = Model(distinct.astype(np.int64), row[kept], follower[kept], frequency, rare, bits)
    where = model.escape_at[row].astype(np.int32)
    where[kept] = np.flatnonzero(model.symbol < k)
    found = np.empty(n, np.int32)
    found[at] = np.repeat(where, count)
    return model, places, found


class _Lanes:
    """State and range coder of the blocks of a group. step() codes one id in each lane.

    The coder is a carry-less range coder with 64-bit state: a range is at least 2 ** 32 before the two events of 16 bits
    that an id takes, and whole words of 32 bits are shifted.
    """

    def __init__(self, model: Model, n: int):
        self.model, self.n = model, n
        self.wide = model.n.bit_length()
        self.base = np.arange(n) * _SLOTS
        self.table = np.zeros(n * _SLOTS, np.int32 if model.n < 1 << 19 else np.int64)  # ((check << wide) + guess) * 4 + confidence, 0 where empty
        # a lane's rates of order 2's hits: four by confidence, then four by how sure order 1 is; below them its weights of both
        self.rate = np.tile(np.array([700, 1500, 2400, 3300, 400, 800, 1600, 2600], np.int32), n)
        self.weight = np.repeat(np.array([[40000], [20000]], np.int32), n, 1)
        self.steps = 0
        # places of the two ids before; 32 bits do, as of what is made of them below only bits up to the 19th count
        self.one, self.two = np.full(n, model.n, np.int32), np.full(n, model.n, np.int32)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, _FULL, np.uint64)

    def keep(self, n: int) -> None:
        """Goes on with the first n lanes only."""
        if n == self.n:
            return
        for name in ("base", "one", "two", "low", "range"):
            setattr(self, name, getattr(self, name)[:n])
        self.n = n

    def guess(self) -> None:
        """The lanes in which order 2 has a guess (some in seven; only these are mixed), and there the guess and the size of its interval (of 65536)."""
        mixed = self.one * np.int32(40503)
        mixed += self.two * np.int32(60493)
        slot = mixed >> 4
        slot &= _SLOTS - 1
        self.slot = slot + self.base
        entry = self.table.take(self.slot)
        mixed ^= mixed >> 11
        mixed &= 255
        mixed |= 256
        self.check = mixed.astype(entry.dtype, copy=False)
        self.has = has = np.flatnonzero(entry >> self.wide + 2 == self.check)
        entry = entry.take(has)
        self.confidence = entry & 3
        entry >>= 2
        entry &= (1 << self.wide) - 1
        self.guessed = entry
        self.which = at = np.empty((2, len(has)), np.int64)
        at[0], at[1] = self.confidence, self.model.sure4.take(self.one.take(has))
        at += has * 8
        self.was = self.rate.take(at)
        self.said, self.own_weight = _STRETCH.take(self.was), self.weight.take(has, 1)
        odds = self.own_weight * self.said
        odds = odds[0] + odds[1]
        odds >>= 16
        odds += 2048
        self.p = _SQUASH.take(odds, mode="clip")
        self.mine = self.p << 4

    def learn(self, places: np.ndarray, hit: np.ndarray) -> None:
        """Rates, weights and order 2's table after the ids at places; hit: whether order 2 was right, for the lanes in which it had a guess."""
        has, hit = self.has, hit.astype(np.int32)
        goal = hit * np.int32(4095)
        error = goal - self.p
        error *= 6
        self.steps += 1
        change = self.said * error
        change += 8192
        change >>= 14
        change += self.own_weight
        self.weight[:, has] = change
        if self.steps % 64 == 0:  # between, a weight moves by 2 ** 18 at most, so products stay below 2 ** 31
            np.clip(self.weight, -(1 << 18), 1 << 18, out=self.weight)
        change = goal - self.was
        change >>= 4
        change += self.was
        self.rate[self.which] = change
        # a guess that held gains confidence; one that didn't makes way for the id
        own = self.check << self.wide
        own += places
        own <<= 2
        sure = np.minimum(self.confidence, 2)
        sure += 1
        sure *= hit
        own[has] += sure
        self.table[self.slot] = own
        self.two, self.one = self.one, places

    def narrow(self, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        """To an interval of 2 ** 16 units; all are uint64."""
        self.low += start * unit
        np.multiply(unit, size, out=self.range)

    def narrow_rare(self, at: np.ndarray, places: np.ndarray, unit: np.ndarray) -> None:
        """The lanes at to their ids' intervals in order 0."""
        self.low[at] += self.model.rare_start[places].astype(np.uint64) * unit
        self.range[at] = unit * self.model.rare[places].astype(np.uint64)
        self.shift(at)

    def shift(self, among: np.ndarray | None = None) -> None:
        """Moves settled words out (or in, when decoding) until every range is 2 ** 32 at least; among: the lanes that may need it, else any."""
        at = np.flatnonzero(self.range <= _LOW) if among is None else among[self.range[among] <= _LOW]
        if len(at):
            low, size = self.low.take(at), self.range.take(at)
            # where a range stands across a word's end it is cut down to the part before it
            across = np.flatnonzero((low ^ (low + size)) > _LOW)
            if len(across):
                cut = _LOW - (low[across] & _LOW)
                cut += cut == 0
                size[across] = cut
            self.move(at, low)
            low <<= _32
            size <<= _32
            self.low[at], self.range[at] = low, size


class _Encoder(_Lanes):
    def __init__(self, model: Model, n: int):
        super().__init__(model, n)
        #: words that were moved out, and their lanes (a lane's in order)
        self.words, self.lanes = [], []

    def move(self, at: np.ndarray, low: np.ndarray) -> None:
        self.words.append((low >> _32).astype("<u4"))
        self.lanes.append(at.astype(np.uint16 if at[-1] < 1 << 16 else np.int64))

    def step(self, places: np.ndarray, start: np.ndarray, size: np.ndarray, escaped: np.ndarray) -> None:
        """places: of the ids; start and size: of their intervals in order 1 (written to); escaped: whether order 1 lacks them (written to)."""
        self.guess()
        has, mine = self.has, self.mine.astype(np.uint64)
        hit = self.guessed == places.take(has)
        unit = self.range.take(has) >> _16
        self.low[has] += mine * ~hit * unit
        self.range[has] = np.where(hit, mine, _TOTAL - mine) * unit
        right = has[hit]
        start[right], size[right], escaped[right] = 0, _ONE, False
        self.narrow(start, size, self.range >> _16)
        self.shift()
        at = np.flatnonzero(escaped)
        if len(at):
            self.narrow_rare(at, places[at], self.range[at] >> np.uint64(self.model.bits))
        self.learn(places, hit)

    def finish(self, low: np.ndarray) -> list[bytes]:
        """The bytes of every lane; low: of every lane, also of those that ended before."""
        every = np.arange(len(low))
        for _ in range(2):
            self.move(every, low)
            low = low << _32
        lanes = np.concatenate(self.lanes)
        data = np.concatenate(self.words)[np.argsort(lanes, kind="stable")].tobytes()
        ends = (4 * np.cumsum(np.bincount(lanes, minlength=len(low)))).tolist()
        return [data[a:b].rstrip(b"\0") for a, b in zip([0, *ends], ends)]


class _Decoder(_Lanes):
    """Zero bytes at a block's end are left out of it; past its end, a block reads as zeros."""

    def __init__(self, model: Model, blocks: Sequence[bytes]):
        super().__init__(model, len(blocks))
        padded = [b + bytes(-len(b) % 4) for b in blocks]
        sizes = np.array([len(b) // 4 for b in padded], np.int64)
        self.end = np.cumsum(sizes)
        self.data, self.at, self.code = np.frombuffer(b"".join(padded) + bytes(4), "<u4"), self.end - sizes, np.zeros(len(blocks), np.uint64)
        # an interval's start, size less 1 and symbol in one number, so that they take one look-up; a start is up to 2 ** 16
        self.whole = model.symbol.astype(np.int64) << 33 | model.start.astype(np.int64) << 16 | model.size - 1
        # where order 1's intervals are looked up: the one in which each of a row's equal parts begins, of which there are some more than intervals
        many = np.diff(model.escape_at, prepend=-1)
        parts = np.where(many > 1, np.minimum((many * (4 if len(self.whole) < 1 << 18 else 1) - 1), _ONE - 1), 0)
        bits = np.frexp(parts.astype(np.float64))[1].astype(np.int64)
        self.parts = (np.cumsum(1 << bits) - (1 << bits)) << 5 | 16 - bits  # a row's first part, and a part's width in bits
        width = np.repeat(16 - bits, many)
        self.hint = np.repeat(np.arange(len(self.whole), dtype=np.int32), -(-(model.start + model.size) >> width) - -(-model.start >> width))
        self.first = self.whole[self.hint]
        every = np.arange(len(blocks))
        for _ in range(2):
            self.move(every, self.low)

    def move(self, at: np.ndarray, low: np.ndarray) -> None:
        place = self.at.take(at)
        word = self.data.take(place, mode="clip") * (place < self.end.take(at))
        code = self.code.take(at)
        code <<= _32
        code |= word
        self.code[at] = code
        place += 1
        self.at[at] = place

    def target(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Where in its range, cut into _ONE parts, the code stands in each of the lanes at."""
        above, unit = self.code[: self.n][at] - self.low[at], self.range[at] >> _16
        goal = (above.astype(np.float64) / unit).astype(np.int64)
        # a quotient of floats may be off by one; whole numbers take several times as long
        off = np.flatnonzero(above - goal.view(np.uint64) * unit >= unit)
        if len(off):
            goal[off] = above[off] // unit[off]
        return np.minimum(goal, _ONE - 1, out=goal)

    def part_of(self, row: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The part of a row in which a goal stands."""
        part = self.parts.take(row)
        width = part & 31
        part >>= 5
        part += goal >> width
        return part

    def interval_of(self, row: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The interval of a row in which a goal stands, from the first of its part on."""
        place, late = self.hint.take(self.part_of(row, goal)), np.arange(len(row))
        while len(late):
            late = late[(self.model.start.take(own := place[late]) + self.model.size.take(own)) <= goal[late]]
            place[late] += 1
        return place

    def step(self) -> np.ndarray:
        model = self.model
        self.guess()
        has, mine = self.has, self.mine.astype(np.uint64)
        unit, low = self.range.take(has) >> _16, self.low.take(has)
        bound = mine * unit
        hit = self.code.take(has) - low < bound
        self.low[has] = low + bound * ~hit
        self.range[has] = np.where(hit, mine, _TOTAL - mine) * unit
        above, unit = self.code[: self.n] - self.low, self.range >> _16
        goal = (above.astype(np.float64) / unit).astype(np.int64)
        whole = self.first.take(self.part_of(self.one, np.minimum(goal, _ONE - 1, out=goal)))
        start, size = whole >> 16, whole & _ONE - 1
        start &= (_ONE << 1) - 1
        size += 1
        whole >>= 33
        places = whole.astype(np.int32)
        right = has[hit]
        start[right], size[right], places[right] = 0, _ONE, self.guessed[hit]
        start, size = start.view(np.uint64) * unit, size.view(np.uint64) * unit
        # the code stands in the interval found, or in a later one of its part, or the quotient of floats was off
        above -= start
        late = np.flatnonzero(above >= size)
        if len(late):
            place, of = self.interval_of(self.one[late], self.target(late)), unit[late]
            places[late] = model.symbol[place]
            start[late], size[late] = model.start[place].astype(np.uint64) * of, model.size[place].astype(np.uint64) * of
        self.low += start
        self.range = size
        self.shift()
        at = np.flatnonzero(places == model.n)
        if len(at):
            unit = self.range[at] >> np.uint64(model.bits)
            goal = np.minimum((self.code[at] - self.low[at]) // unit, np.uint64((1 << model.bits) - 1)).astype(np.int64)
            own = np.searchsorted(model.rare_start, goal, "right") - 1
            self.narrow_rare(at, own, unit)
            places[at] = own
        self.learn(places, hit)
        return places


def _check_ids(ids: np.ndarray) -> np.ndarray:
    found = np.asarray(ids)
    if len(found) and (found.dtype.kind not in "iu" or int(found.min()) < 0 or int(found.max()) >= 1 << 32):
        raise ValueError("ids must be whole numbers from 0 to 2 ** 32 - 1")
    return found.astype(np.uint32, copy=False)


def _columns(values: np.ndarray, lengths: np.ndarray, a: int, b: int) -> np.ndarray:
    """Places a to b of every block, a row for each place; lengths as block_lengths gives them. Past a block's end anything."""
    lanes, longest = len(lengths), int(lengths[0])
    long = int((lengths == longest).sum())
    out, cut = np.zeros((b - a, lanes), values.dtype), long * longest
    out[:, :long] = values[:cut].reshape(long, longest)[:, a:b].T
    if long < lanes:
        rest = values[cut:].reshape(lanes - long, longest - 1)[:, a:b].T
        out[: len(rest), long:] = rest
    return out


def encode_group(ids: np.ndarray) -> tuple[bytes, list[tuple[np.ndarray, bytes]]]:
    """A group of up to GROUP ids (0 to 2 ** 32 - 1) to its model's bytes, and the ids and bytes of each block."""
    ids = _check_ids(ids)
    if len(ids) > GROUP:
        raise ValueError(f"a group has {GROUP} ids at most")
    lengths = block_lengths(len(ids))
    if not len(lengths):
        return b"", []
    model, places, found = _fitted(ids, lengths)
    starts, longest, lanes = np.cumsum(lengths) - lengths, int(lengths[0]), len(lengths)
    places = places.astype(np.int32, copy=False)
    coder = _Encoder(model, lanes)
    # start, whether it is an escape, and size in one number, so that they take one look-up
    intervals = model.start.astype(np.uint64) | (model.symbol == model.n).astype(np.uint64) << np.uint64(31) | model.size.astype(np.uint64) << _32
    low = coder.low
    for t in range(longest):
        if t % 64 == 0:  # the next columns of blocks, as rows
            own_rows, where = (_columns(x, lengths, t, min(t + 64, longest)) for x in (places, found))
            start_rows = intervals[where]
            size_rows = start_rows >> _32
            escaped_rows = start_rows & np.uint64(1 << 31) > 0
            start_rows &= np.uint64((1 << 31) - 1)
        n = lanes if t < int(lengths[-1]) else int((lengths > t).sum())
        coder.keep(n)
        r = t % 64
        coder.step(own_rows[r, :n], start_rows[r, :n], size_rows[r, :n], escaped_rows[r, :n])
    coded = coder.finish(low)
    return model.dump(), [(ids[a : a + n], data) for a, n, data in zip(starts.tolist(), lengths.tolist(), coded, strict=True)]


def decode_group(model: bytes, blocks: Sequence[bytes], n: int) -> list[np.ndarray]:
    """The n ids of a group, block by block, from its model's bytes and its blocks'."""
    lengths = block_lengths(n)
    if len(lengths) != len(blocks):
        raise ValueError("a group's blocks don't fit its number of ids")
    if not n:
        return []
    made, longest, lanes = Model.load(model), int(lengths[0]), len(lengths)
    coder = _Decoder(made, blocks)
    ids, rows, out = made.ids.astype(np.uint32), np.zeros((64, lanes), np.int32), np.empty((lanes, longest), np.uint32)
    for t in range(longest):
        k = lanes if t < int(lengths[-1]) else int((lengths > t).sum())
        coder.keep(k)
        rows[t % 64, :k] = coder.step()
        if t % 64 == 63 or t + 1 == longest:  # columns of blocks
            out[:, t - t % 64 : t + 1] = ids[rows[: t % 64 + 1]].T
    return [out[i, :k] for i, k in enumerate(lengths.tolist())]


def checksum(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
