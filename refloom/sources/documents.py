"""Documents as files: any format that a converter turns to text, chunk by chunk, as a table function.

binaryFile gives one row per document. A converter, chosen by the file's ending, yields the document's text in pieces, as
long or short as it likes; the table function cuts these to chunks of whole lines while they come, so what a task holds
is a document's bytes and one chunk, and time is linear in the text.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from refloom.functions.text import WHITE

CHUNK = "chunk_no int, offset long, chunk string"
#: A converter: bytes of a document to pieces of its text, in order.
Converter = Callable[[bytes], Iterator[str]]


def plain_text(content: bytes, size: int = 1 << 20) -> Iterator[str]:
    """UTF-8, piece by piece; what isn't UTF-8 becomes U+FFFD."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    for k in range(0, len(content), size):
        yield decode(content[k : k + size])
    yield decode(b"", final=True)


def _lines(pieces: Iterator[str]) -> Iterator[str]:
    """The text's parts between line ends, wherever pieces end."""
    rest: list[str] = []
    for piece in pieces:
        *whole, last = piece.split("\n")
        for line in whole:
            yield "".join([*rest, line])
            rest = []
        rest.append(last)
    yield "".join(rest)


def chunks_of(pieces: Iterator[str], max_chars: int) -> Iterator[tuple[int, int, str]]:
    """(chunk_no, offset, chunk) of whole lines, as spans.chunk_by_newline cuts them: a longer line is a chunk of its own, blank ones are left out."""
    cursor = begin = size = number = 0
    now: list[str] = []
    blank = True
    for line in _lines(pieces):
        if size + len(line) + 1 > max_chars and not blank:
            yield number, begin, "\n".join(now).rstrip("\n")
            number, begin, size, blank, now = number + 1, cursor, 0, True, []
        now.append(line)
        size, cursor = size + len(line) + 1, cursor + len(line) + 1
        blank = blank and not line.strip(WHITE)
    if not blank:
        yield number, begin, "\n".join(now).rstrip("\n")


def chunk_function(converters: Mapping[str, Converter] | None = None):
    """A table function (path, content, max_chars) to chunks; converters by a path's ending in lower case, plain text for others. Null content has none."""
    own = dict(converters or {})

    class DocumentChunks:
        def eval(self, path: str, content: bytes, max_chars: int):
            if content is not None:
                convert = own.get((path or "").rpartition(".")[2].lower(), plain_text)
                yield from chunks_of(convert(content), max_chars)

    return udtf(DocumentChunks, returnType=CHUNK, useArrow=True)


def register_chunks(spark: SparkSession, converters: Mapping[str, Converter] | None = None, name: str = "document_chunks") -> None:
    """For SQL: SELECT ... FROM documents, LATERAL document_chunks(path, content, 2000)."""
    spark.udtf.register(name, chunk_function(converters))


def read_documents(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """path, length and content of each file below paths."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(paths).select("path", "length", "content")


def chunk_documents(files: DataFrame, converters: Mapping[str, Converter] | None = None, max_chars: int = 2000) -> DataFrame:
    """Rows with path and content to their other columns and chunk_no, offset (in characters of the whole text) and chunk, a row each."""
    function = chunk_function(converters)
    others = [c for c in files.columns if c != "content"]
    cut = function(F.col("path").outer(), F.col("content").outer(), F.lit(max_chars))
    return files.lateralJoin(cut).select(*others, "chunk_no", "offset", "chunk")
