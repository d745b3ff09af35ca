"""Token ids of documents in a compressed binary format, written in the order of doc_id and read back.

A file holds the ids of consecutive documents as one stream, cut into groups of idcodec.GROUP ids and these into blocks
that are coded alone (see idcodec) and have a checksum each, and an index of its documents:

    header   b"RLIDS002"
    group    ids (u32), blocks (u32), bytes of the model (u32), then the model; again and again, each followed by its blocks
    block    ids (u32), bytes (u32), crc32 of the ids as little-endian u32 (u32), then the bytes
    index    zlib of: null flags (a byte each), doc_ids (i64), numbers of ids (u64), one array after the other
    trailer  documents (u64), ids (u64), offset of the index (u64), crc32 of the index (u32), b"RLIDSEND"

Integers are little-endian.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from refloom.llm.files import opened, written
from refloom.llm.idcodec import GROUP, checksum, decode_group, encode_group
from refloom.llm.shared import materialize, new_place
from refloom.llm.text import kept, lean, rows_of

MAGIC, END = b"RLIDS002", b"RLIDSEND"
_GROUP, _BLOCK, _TRAILER = struct.Struct("<III"), struct.Struct("<III"), struct.Struct("<QQQI8s")
#: A file is closed after the document with which it has so many ids, or so many documents.
FILE_IDS, FILE_DOCUMENTS = 1 << 24, 1 << 20
#: Chunks whose ids a worker keeps; beyond that it forgets those that it met once.
CACHED = 600_000
#: Bytes of text that are cut into chunks at a time (whole texts).
SLICE = 1 << 23
#: Pieces that go to the library's model at a time: it makes some 200 bytes of an id.
LEARNED = 1 << 15
#: Kinds of bytes that a piece has side by side: 1 letter, 2 digit, 3 another sign; 0 where that takes a closer look.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_KIND[[*b"0123456789"]] = 2
_KIND[ord("'")] = 0
#: And in higher bits: 4 space or line end, 8 ASCII that is no white space, 16 surely begins a character that is none, 32 of a character beyond ASCII.
_BYTE = np.arange(256)
_CLASSES = (_KIND + 4 * np.isin(_BYTE, (10, 32)) + 8 * ((_BYTE > 32) & (_BYTE < 127)) + 16 * ((_BYTE > 32) & (_BYTE < 127) | (_BYTE >= 0xC3) & (_BYTE <= 0xE0) | (_BYTE >= 0xE4)) + 32 * (_BYTE >= 128)).astype(np.uint8).tobytes()

# Fixed value: where a byte-level BPE of this kind cuts a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 ones stand for themselves, the others in turn for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _no_space(data: np.ndarray, at: np.ndarray, last: bool) -> np.ndarray:
    """Whether the UTF-8 character that ends (last) or begins at each place is surely no white space; where unsure, false."""
    byte = data[at]
    sure = (byte > 32) & (byte < 127)
    if not last:
        return sure | (byte >= 0xC3) & (byte <= 0xE0) | (byte >= 0xE4)
    unsure = np.flatnonzero((byte >= 0x80) & (at >= 3))
    place = at[unsure]
    one, two, three = data[place - 1], data[place - 2], data[place - 3]
    # every character of white space outside ASCII begins with C2, E1, E2 or E3
    sure[unsure] = (one >= 0xC3) & (one <= 0xDF) | (one < 0xC0) & ((two == 0xE0) | (two >= 0xE4) & (two < 0xF0) | (two < 0xC0) & (three >= 0xF0))
    return sure


class _Pool:
    """Ids of strings that were met before: a string to its row, where its ids stand in one array."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.start, self.count, self.met, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def forget(self) -> None:
        """Keeps the strings that were met again, three quarters of CACHED at most: those met most often. Earlier meetings count half from now on."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > 3 * CACHED // 4:
            keep = np.sort(keep[np.argpartition(-self.met[keep], 3 * CACHED // 4)[: 3 * CACHED // 4]])
        ids, ends = self.of(keep)
        names = list(self.known)
        self.known = {names[i]: row for row, i in enumerate(keep.tolist())}
        self.count, self.met, self.ids = self.count[keep], self.met[keep] >> 1, ids
        self.start = (ends - self.count).astype(np.int32)

    def rows(self, strings: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The rows of distinct strings; learn gives the ids of new ones, one after the other, and their numbers of ids."""
        if len(self.known) > CACHED:
            self.forget()
        found = np.fromiter(map(self.known.get, _list(strings), repeat(-1)), np.int64, len(strings))
        new = found < 0
        if new.any():
            fresh, many = strings.filter(pa.array(new)), len(self.known)
            ids, counts = learn(fresh)
            found[new] = np.arange(many, many + len(fresh))
            self.known.update(zip(_list(fresh), range(many, many + len(fresh))))
            self.start = np.concatenate((self.start, (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)))
            self.count, self.ids = np.concatenate((self.count, counts.astype(np.int32))), np.concatenate((self.ids, ids.astype(np.uint32)))
            self.met = np.concatenate((self.met, np.zeros(len(fresh), np.int32)))
        self.met[found] += 1
        return found

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, one after the other, and where each row's end."""
        n = self.count[rows]
        ends = np.cumsum(n, dtype=np.int64)
        many = int(ends[-1]) if len(ends) else 0
        at = np.arange(many, dtype=np.int32 if many < 1 << 31 else np.int64)
        at += np.repeat((self.start[rows] - (ends - n)).astype(at.dtype), n)
        return self.ids[at], ends


def _list(strings: pa.Array) -> list[bytes]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _merged(first: np.ndarray, ids: np.ndarray, counts: np.ndarray, others: np.ndarray, other_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers of strings in order: where first is set the next of ids and counts, else the next of the others."""
    many = np.zeros(len(first), np.int64)
    many[first], many[~first] = counts, other_counts
    out, own = np.zeros(int(many.sum()), np.uint32), np.repeat(first, many)
    out[own], out[~own] = ids, others
    return out, many


class CachedEncoder:
    """Ids of texts by a tokenizer of the tokenizers library, a column of texts at a time.

    A byte-level BPE first cuts a text into pieces by a pattern, and no piece depends on the others. A space or line end
    between two characters that are no white space always begins a piece, and so does an ASCII letter, digit or other sign
    (but the apostrophe) after one of another of these kinds: so texts are cut there, and the ids of chunks are kept. Arrow
    finds a column's distinct chunks; of the new ones those of one kind are pieces and go to the library's model, others
    are cut by the pattern first. Any other kind of tokenizer gets whole texts. Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        cut = made.get("pre_tokenizer") or {}
        ordinary = all(t.get("special") for t in made.get("added_tokens", []))
        self.by_piece = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not made.get("normalizer") and ordinary and (made.get("model") or {}).get("type", "BPE") == "BPE"
        if self.by_piece:
            self.pieces_of = regex.compile(BYTE_LEVEL_PATTERN).findall
            # pieces go to the model in its own letters, one a line; 255 is no byte of UTF-8
            self.letters = _byte_letters() | {255: "\n"}
            self.lines = Tokenizer(self.tokenizer.model)
            self.lines.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
            # the model's own cache of pieces only costs time, as it gets none twice
            if resize := getattr(self.lines.model, "_resize_cache", None):
                resize(0)
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
            self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))
        self.chunks, self.pieces = _Pool(), _Pool()

    def _wholes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _learn_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after the other, and their numbers of ids. A chunk of one kind, or a space and one kind, is a piece; a line end and one kind are two."""
        data, sizes = np.frombuffer(b"".join(_list(chunks)), np.uint8), pc.binary_length(chunks).to_numpy()
        starts = np.cumsum(sizes) - sizes
        kind = _KIND[data]
        # U+00C0 to U+00FF are letters, but the signs of multiplication and division
        latin = np.flatnonzero(data == 0xC3)
        latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
        kind[latin] = kind[latin + 1] = 1
        line = (data[starts] == 10) & (sizes > 1)
        headed = starts[line | (data[starts] == 32) & (sizes > 1)]
        kind[headed] = kind[headed + 1]
        least = np.minimum.reduceat(kind, starts)
        pieces = (least > 0) & (least == np.maximum.reduceat(kind, starts))
        line &= pieces
        own = np.repeat(pieces, sizes)
        own[starts[line]] = False
        ends = np.cumsum((sizes - line)[pieces])
        ids, counts = self._learn_pieces(pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(data[own])]))
        if line.any():
            lines = line[pieces]
            head = self._learn_pieces(pa.array([b"\n"], pa.large_binary()))[0]
            ids = np.insert(ids, np.repeat((np.cumsum(counts) - counts)[lines], len(head)), np.tile(head, int(lines.sum())))
            counts = counts + len(head) * lines
        others, other_counts = self._learn_cut(chunks.filter(pa.array(~pieces)))
        return _merged(pieces, ids, counts, others, other_counts)

    def _learn_cut(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with a space or line end and a character, and end with one don't depend on what stands next to them, so the pattern runs over all of them at once."""
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        listed, sizes = _list(chunks), pc.binary_length(chunks).to_numpy()
        data, ends = np.frombuffer(b"".join(listed), np.uint8), np.cumsum(sizes)
        apart = sizes > 1
        at = ends[apart]
        head = data[at - sizes[apart]]
        apart[apart] = ((head == 32) | (head == 10)) & _no_space(data, at - sizes[apart] + 1, False) & _no_space(data, at - 1, True)
        alone = apart.tolist()
        text = b"".join([c for c, a in zip(listed, alone, strict=True) if a]).decode()
        pieces = pa.array(self.pieces_of(text), pa.large_string()).cast(pa.large_binary())
        distinct = pieces.dictionary_encode()
        ids, upto = self.pieces.of(self.pieces.rows(distinct.dictionary, self._learn_pieces)[distinct.indices.to_numpy()])
        last = np.searchsorted(np.cumsum(pc.binary_length(pieces).to_numpy()), np.cumsum(sizes[apart]))
        others, other_counts = self._wholes([c.decode() for c, a in zip(listed, alone, strict=True) if not a])
        return _merged(apart, ids, np.diff(upto[last], prepend=0), others, other_counts)

    def _learn_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self._some_pieces(pieces.slice(a, LEARNED)) for a in range(0, len(pieces), LEARNED)]
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _some_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = _list(pieces)
        ids = np.array(self.lines.encode_batch_fast([b"\xff".join(raw).decode("latin-1").translate(self.letters)], add_special_tokens=False)[0].ids, np.int64)
        reached, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum(pc.binary_length(pieces).to_numpy())
        last = np.searchsorted(reached, wanted)
        if len(ids) and reached[-1] == wanted[-1] and np.array_equal(reached[last], wanted):
            return ids, np.diff(last + 1, prepend=0)
        return self._wholes([p.decode() for p in raw])  # a vocabulary that lacks some byte

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of some texts (strings; null: empty) after the other, all in one array, and the number of ids of each text."""
        if not self.by_piece:
            for a in range(0, len(texts), 256):
                yield self._wholes(texts[a : a + 256].fill_null("").to_pylist())
            return
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        a = 0
        while a < len(texts):
            # some megabytes at a time, one text at least
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
            yield self._slice(texts, offsets[a : b + 1])
            a = b

    def _slice(self, texts: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = int(offsets[0]), int(offsets[-1])
        if begin == end:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        buffer = texts.buffers()[2].slice(begin, end - begin)
        data, bounds = np.frombuffer(buffer, np.uint8), offsets - begin
        classes = np.frombuffer(buffer.to_pybytes().translate(_CLASSES), np.uint8)
        begins = np.zeros(len(data) + 1, bool)
        space = classes[1:-1] >> 2
        space &= classes[2:] >> 4
        begins[1:-2] = (space & classes[:-2] >> 3 & 1).view(bool)
        beyond = np.flatnonzero(space & classes[:-2] >> 5 & 1) + 1
        begins[beyond[_no_space(data, beyond - 1, True)]] = True
        kind = classes & 3
        begins[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        begins[bounds] = True
        cuts = np.flatnonzero(begins)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), buffer]).dictionary_encode()
        ids, ends = self.chunks.of(self.chunks.rows(chunks.dictionary, self._learn_chunks)[chunks.indices.to_numpy()])
        reached = np.concatenate(([0], ends))[np.searchsorted(cuts, bounds)]
        return ids, np.diff(reached)


def encoder_of(path: str) -> CachedEncoder:
    """The worker process's encoder, which keeps its chunks from task to task."""
    return kept(("encoder", path), lambda: CachedEncoder(path))


class Documents(NamedTuple):
    """Consecutive documents: ids (masked where null), the number of token ids of each, and these, one after the other."""

    doc_ids: np.ma.MaskedArray
    lengths: np.ndarray
    ids: np.ndarray

    def cut(self, k: int) -> tuple[Documents, Documents]:
        """The first k and the others."""
        at = int(self.lengths[:k].sum())
        return Documents(self.doc_ids[:k], self.lengths[:k], self.ids[:at]), Documents(self.doc_ids[k:], self.lengths[k:], self.ids[at:])


class FileWriter:
    """Writes documents to a stream; a group of ids at most is held."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.documents = self.total = self.size = 0
        self.doc_ids: list[np.ma.MaskedArray] = []
        self.lengths: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, more: Documents) -> None:
        self.doc_ids.append(more.doc_ids)
        self.lengths.append(more.lengths)
        self.documents += len(more.lengths)
        self.total += len(more.ids)
        rest = more.ids
        while self.size + len(rest) >= GROUP:
            room = GROUP - self.size
            self.held.append(rest[:room])
            rest = rest[room:]
            self.flush()
        self.held.append(rest)
        self.size += len(rest)

    def flush(self) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        self.held, self.size = [], 0
        if len(ids):
            model, blocks = encode_group(ids)
            parts = [_GROUP.pack(len(ids), len(blocks), len(model)), model]
            for block, coded in blocks:
                parts += [_BLOCK.pack(len(block), len(coded), checksum(block)), coded]
            data = b"".join(parts)
            self.out.write(data)
            self.at += len(data)

    def finish(self) -> None:
        self.flush()
        doc_ids, lengths = np.ma.concatenate(self.doc_ids) if self.doc_ids else np.ma.zeros(0, np.int64), np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)
        index = zlib.compress(np.ma.getmaskarray(doc_ids).astype(np.uint8).tobytes() + doc_ids.filled(0).astype("<i8").tobytes() + lengths.astype("<u8").tobytes())
        self.out.write(index + _TRAILER.pack(self.documents, self.total, self.at, zlib.crc32(index), END))


def read_index(file, size: int) -> tuple[np.ma.MaskedArray, np.ndarray, int]:
    """Ids and lengths of a file's documents, and the offset where its groups end; ValueError if it isn't whole."""
    if size < len(MAGIC) + _TRAILER.size:
        raise ValueError("a token file is cut off")
    file.seek(size - _TRAILER.size)
    docs, ids, at, crc, end = _TRAILER.unpack(file.read(_TRAILER.size))
    if end != END:
        raise ValueError("a token file's end is damaged")
    file.seek(at)
    index = file.read(size - _TRAILER.size - at)
    if zlib.crc32(index) != crc:
        raise ValueError("a token file's index is damaged")
    raw = zlib.decompress(index)
    null, doc_ids, lengths = np.frombuffer(raw[:docs], np.uint8), np.frombuffer(raw[docs : 9 * docs], "<i8"), np.frombuffer(raw[9 * docs :], "<u8")
    if int(lengths.sum()) != ids:
        raise ValueError("a token file's index doesn't add up")
    return np.ma.MaskedArray(doc_ids, null.astype(bool)), lengths.astype(np.int64), at


def read_ids(file, end: int) -> Iterator[np.ndarray]:
    """The ids of a file, a group at a time, each block held against its checksum."""
    file.seek(0)
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)
    while at < end:
        n, k, size = _GROUP.unpack(file.read(_GROUP.size))
        model = file.read(size)
        at += _GROUP.size + size
        heads, blocks = [], []
        for _ in range(k):
            head = _BLOCK.unpack(file.read(_BLOCK.size))
            heads.append(head)
            blocks.append(file.read(head[1]))
            at += _BLOCK.size + head[1]
        found = decode_group(model, blocks, n)
        for ids, head in zip(found, heads, strict=True):
            if len(ids) != head[0] or checksum(ids) != head[2]:
                raise ValueError("a block of ids doesn't fit its checksum")
        yield np.concatenate(found)


def read_documents(file, size: int) -> Iterator[tuple[np.ma.MaskedArray, np.ndarray, np.ndarray]]:
    """(doc_ids, numbers of ids, crc32 of the ids) of a file's documents in order, as arrays of those that end in a group."""
    doc_ids, lengths, end = read_index(file, size)
    ends = np.cumsum(lengths)
    done, crc, reached = 0, 0, 0  # documents that are whole, what is known of the next, ids read
    for ids in chain(read_ids(file, end), [np.zeros(0, np.uint32)]):
        data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        upto = int(np.searchsorted(ends, reached + len(ids), "right"))
        bounds = (4 * (ends[done:upto] - reached)).tolist()
        sums, at = [], 0
        for bound in bounds:
            sums.append(zlib.crc32(data[at:bound], crc))
            at, crc = bound, 0
        crc = zlib.crc32(data[at:], crc)
        if bounds:
            yield doc_ids[done:upto], lengths[done:upto], np.array(sums, np.int64)
        done, reached = upto, reached + len(ids)
    if done < len(lengths):
        raise ValueError("a token file lacks ids")


def write_files(parts: Iterable[Documents], place: str, task: int, file_ids: int = FILE_IDS, file_documents: int = FILE_DOCUMENTS) -> Iterator[tuple[int, str, int, int]]:
    """Writes documents to files below place; gives number, path, documents and ids of each."""
    parts = iter(parts)
    rest, number = next(parts, None), 0
    while rest is not None:
        path = f"{place}/ids-{task:05d}-{number:04d}.rlids"
        with written(path) as out:
            file = FileWriter(out)
            while rest is not None and file.total < file_ids and file.documents < file_documents:
                k = min(int(np.searchsorted(np.cumsum(rest.lengths), file_ids - file.total)) + 1, file_documents - file.documents)
                own, rest = rest.cut(k)
                file.add(own)
                if not len(rest.lengths):
                    rest = next(parts, None)
            file.finish()
        yield number, path, file.documents, file.total
        number += 1


def write_tokens(docs: DataFrame, place: str, tokenizer: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS, text: str = "text") -> DataFrame:
    """Writes the ids of every row of docs, then end_id, to files below place in ascending doc_id; one row per file: path, documents, ids, start.

    Null ids come first; rows of equal id are in the order of their text's hash; null and empty texts have the end id
    only; an empty table gives no file; other columns are not looked at. A doc_id that is no whole number is refused
    with TypeError. Rows are dealt out by range of doc_id, hash and place in the input, so no partition's size depends
    on a few ids or on rows that are repeated, and a task holds one batch of texts and one group of ids. start: ids in
    all files before it, from a window over one row per file. Files get their names once whole, so tasks that run
    again do no harm.
    """
    if not isinstance(docs.schema["doc_id"].dataType, (IntegralType, NullType)):
        raise TypeError("doc_id must be of a whole-number type: the file format keeps 64-bit integers")
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", "h", "at"]
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(path), TaskContext.get().partitionId()

        def parts() -> Iterator[Documents]:
            for batch in batches:
                if batch.num_rows:
                    doc_ids = batch.column(batch.schema.get_field_index("doc_id"))
                    keys, at = np.ma.MaskedArray(doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False)), 0
                    for ids, lengths in encoder.encode(batch.column(batch.schema.get_field_index("text"))):
                        # the end id after each document's
                        yield Documents(keys[at : at + len(lengths)], lengths + 1, np.insert(ids, np.cumsum(lengths), end_id))
                        at += len(lengths)

        for number, name, documents, ids in write_files(parts(), place, task, file_ids):
            yield pa.RecordBatch.from_pydict({"part": pa.array([task], pa.int32()), "number": pa.array([number], pa.int32()), "path": [name], "documents": pa.array([documents], pa.int64()), "ids": pa.array([ids], pa.int64())})

    files = materialize(rows.mapInArrow(lean(run, keeps=True), "part int, number int, path string, documents long, ids long"), "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", "documents", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def read_tokens(files: DataFrame) -> DataFrame:
    """One row per document of the files (path, start): doc_id, start, n_tokens, ids_crc32. A task reads files as streams, a group of ids at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in rows_of(batch, "path", "start"):
                system, name = opened(path)
                with system.open_input_file(name) as file:
                    for doc_ids, n, sums in read_documents(file, file.size()):
                        ends = start + np.cumsum(n)
                        keys = pa.array(np.ma.getdata(doc_ids), pa.int64(), mask=np.ma.getmaskarray(doc_ids))
                        yield pa.RecordBatch.from_arrays([keys, pa.array(ends - n), pa.array(n), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start = int(ends[-1])

    files = materialize(files.select("path", "start"), "token-starts")
    return files.repartition(max(1, files.count())).mapInArrow(lean(run, keeps=True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_place(spark, "tokens")))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(docs, new_place(spark, "tokens")))
