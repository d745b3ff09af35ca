"""String building blocks: white space, titles, query values, tokenizer debris. Column to Column, no UDFs.

Empty and blank strings count as missing: every function gives null for them unless it says otherwise. Word
characters and white space are Unicode's: regular expressions carry (?U) for the former, and WHITE_CLASS for the latter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once and written once in the plan: without it an expression that names its
    input several times, made of others that do, grows exponentially. No Python UDF may be in use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Unicode's white space, as the characters and as part of a character class: a class without (?U) is several times faster.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITE_CLASS = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, f"[{WHITE_CLASS}]+", " ")


def present(c: Column) -> Column:
    """The string, or null where it is null or blank."""
    return F.when(c.rlike(f"[^{WHITE_CLASS}]"), c)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def words(c: Column) -> Column:
    """The words between white space, none of them empty; null for null."""
    return F.filter(F.split(c, f"[{WHITE_CLASS}]+"), lambda w: w != "")


def normalize_text(c: Column) -> Column:
    """Lower case, punctuation as space, single spaces; may be empty."""
    return strip(squeeze(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " ")))


def clean_title(c: Column) -> Column:
    """Without quotes and trailing punctuation; null under 3 characters."""
    bare = strip(squeeze(F.translate(c, "'\"", "")))
    bare = F.rtrim(bare, F.lit(".,;:-" + WHITE))
    return let(bare, lambda b: F.when(F.length(b) >= 3, b))


def segment_title(c: Column) -> Column:
    """Both halves of a title's words, joined by |; a title under 4 words stays whole."""

    def cut(parts: Column) -> Column:
        n = F.size(parts)
        half = F.floor(n / 2).cast("int")
        halves = F.concat(F.array_join(F.slice(parts, F.lit(1), half), " "), F.lit("|"), F.array_join(F.slice(parts, half + 1, n), " "))
        return F.when(n < 4, F.array_join(parts, " ")).otherwise(halves)

    return let(words(clean_title(c)), cut)


def clean_filter_value(c: Column) -> Column:
    """A value fit for a filter of the form key:value: no parentheses' content, no separators, plain dashes; null under 3 characters."""
    v = F.regexp_replace(c, r"\([^)]*\)", "")
    v = F.regexp_replace(v, r"[:/]", " ")
    v = F.regexp_replace(v, r"[,;\"'`]", "")
    v = F.regexp_replace(v, "[—–]", "-")
    v = F.regexp_replace(v, r"(?U)[^\w\s\-.()]", "")
    v = strip(squeeze(v))
    return let(v, lambda x: F.when(F.length(x) >= 3, x))


def encode_path(c: Column) -> Column:
    """Percent-encoding in which a space is %20 and / stays."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def encode_form(c: Column) -> Column:
    """Percent-encoding in which a space is +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


# Steps of cleaning a value that a name stands for (an element of an array, or let's): they look at it first, since most need no change.


def _glued(v: Column) -> Column:
    return F.when(F.contains(v, F.lit("##")), F.regexp_replace(v, r"(?U)\s*##(\w+)", "$1")).otherwise(v)


def _closed(v: Column) -> Column:
    joined = v
    for mark in (r"\.", "/", ":", "-"):
        joined = F.regexp_replace(joined, f"[{WHITE_CLASS}]*{mark}[{WHITE_CLASS}]*", mark[-1])
    return F.when(v.rlike(rf"[./:\-][{WHITE_CLASS}]|[{WHITE_CLASS}][./:\-]"), joined).otherwise(v)


def _single(v: Column) -> Column:
    return F.when(v.rlike(f"[{WHITE_CLASS.replace(' ', '')}]|  "), squeeze(v)).otherwise(v)


def _without_pieces(v: Column) -> Column:
    return F.when(F.contains(v, F.lit("##")), F.regexp_replace(v, r"(?U)\b##[^\s]*\b\s*", "")).otherwise(v)


def _bare(v: Column) -> Column:
    return F.btrim(v, F.lit(".,;:-" + WHITE))


_JOIN, _DROP = (_glued, _closed, _single, strip), (_without_pieces, _single, _bare)


def join_subwords(c: Column) -> Column:
    """Glues ##pieces of a subword tokenizer, and drops the spaces it left around . / : and -."""
    return reduce(let, _JOIN, c)


def drop_debris(c: Column) -> Column:
    """Without leftover ## pieces and without punctuation at the ends."""
    return reduce(let, _DROP, c)


def clean_each(values: Column) -> Column:
    """drop_debris(join_subwords()) of each value, a pass over the array for each step."""
    return reduce(F.transform, (*_JOIN, *_DROP), values)


#: Letters outside a-z with their usual transliteration, letter by letter.
LATIN = "àáâãäåāăąçćčďèéêëēęěìíîïīıłñńňòóôõöøōőŕřśšşťţùúûüūůűýÿźžż"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiiilnnnoooooooorrsssttuuuuuuuyyzzz"


def transliterate(c: Column) -> Column:
    """Lower case in the letters a-z as far as Latin letters go."""
    v = F.translate(F.lower(c), LATIN, PLAIN)
    for letter, letters in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ð", "d")):
        v = F.replace(v, F.lit(letter), F.lit(letters))
    return v
