"""Fill-in-middle transformation by lookaround splitting.

A unit grammar says which neighbouring characters stay together. It is translated to a regular expression of width zero
that matches at every other place between two characters, so Spark's split cuts a text into its units and loses
nothing: the pieces, joined again, are the text. Cutting, marking and the way back are expressions over one row: there is
no shuffle, and a plan of any size is one map over the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.shared import free_names


@dataclass(frozen=True)
class UnitGrammar:
    """Pairs of character classes: a character of the first stays with a following one of the second. All others part."""

    glued: tuple[tuple[str, str], ...] = ()

    def boundary(self) -> str:
        """The zero-width regular expression of the places between two units; code points are never cut."""
        together = "".join(f"(?!(?<={left}){right})" for left, right in self.glued)
        return f"(?s)(?<=.){together}(?=.)"

    def units(self, text: Column) -> Column:
        """The units of a text, in order; an empty one, and null, has none."""
        return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, self.boundary(), -1))


#: Single code points.
CHARACTERS = UnitGrammar()
#: [A-Za-z]+|[^A-Za-z]
LETTER_RUNS = UnitGrammar((("[A-Za-z]", "[A-Za-z]"),))
#: Runs of white space, and runs of anything else.
WORDS_AND_SPACE = UnitGrammar(((r"[\x20\x09-\x0D]", r"[\x20\x09-\x0D]"), (r"[^\x20\x09-\x0D]", r"[^\x20\x09-\x0D]")))
#: Lines with their line end.
LINES = UnitGrammar((("[^\n]", "."),))


@dataclass(frozen=True)
class FillInMiddle:
    """percent: documents out of 100 that are transformed; spm_percent: of these, with the suffix first; markers of prefix, suffix, middle; seed goes into the hash of the id."""

    grammar: UnitGrammar = LETTER_RUNS
    percent: int = 90
    spm_percent: int = 20
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    seed: int = 1


def _quoted(text: str) -> str:
    """A regular expression of exactly this text."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def hash_groups(doc_id: Column, seed: int, n: int) -> list[Column]:
    """The first n groups of eight hexadecimal digits of sha256("seed:doc_id"), as unsigned integers; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def join_parts(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column, markers: Sequence[str]) -> Column:
    """The transformed text: prefix, suffix and middle behind their markers, in the order of the form."""
    p, s, m = map(F.lit, markers)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restore(output: Column, form: Column, markers: Sequence[str] = FillInMiddle.markers) -> Column:
    """The text that output was made from. Transformed texts have no marker of their own, so the three markers cut an output into exactly its parts."""
    p, s, m = map(_quoted, markers)
    psm = F.regexp_replace(output, f"(?s)^{p}(.*){s}(.*){m}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{s}(.*){p}(.*){m}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, keep: Sequence[str] = ("doc_id",), how: FillInMiddle = FillInMiddle()) -> DataFrame:
    """keep of every row of docs, with n (units), form, prefix, middle, suffix and output.

    form is plain (prefix, middle and suffix null, output the text) where the text is empty or has a marker, and for
    100 - percent of 100 ids. A null text counts as empty, a null doc_id as an id without digits. Two hashes of the id
    give the two cuts, so rows with equal id and text are transformed alike. Columns of docs that aren't kept play no
    part; a kept one that is named like a new column is called input_<name>. An empty table gives an empty one.
    """
    own = ["n", "form", "prefix", "middle", "suffix", "output"]
    names = free_names(list(keep), own)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)), text.alias("__text"), how.grammar.units(text).alias("__units"), *(h.alias(f"__h{k + 1}") for k, h in enumerate(hash_groups(F.col("doc_id"), how.seed, 4))))
    n = F.size("__units")
    first, second = (F.expr(f"{h} % (size(__units) + 1)") for h in ("__h1", "__h2"))
    marked = F.lit(False)
    for marker in how.markers:
        marked = marked | F.contains("__text", F.lit(marker))
    form = F.when((F.col("__text") == "") | marked | (F.col("__h3") % 100 >= how.percent), F.lit("plain")).when(F.col("__h4") % 100 < how.spm_percent, F.lit("spm")).otherwise(F.lit("psm"))
    rows = rows.withColumns({"n": n.cast("long"), "__a": F.least(first, second).cast("int"), "__b": F.greatest(first, second).cast("int"), "form": form})
    bounds = {"prefix": (F.lit(1), F.col("__a")), "middle": (F.col("__a") + 1, F.col("__b") - F.col("__a")), "suffix": (F.col("__b") + 1, F.size("__units") - F.col("__b"))}
    rows = rows.withColumns({name: F.when(F.col("form") != "plain", F.array_join(F.slice("__units", start, length), "")) for name, (start, length) in bounds.items()})
    output = join_parts(F.col("form"), F.col("__text"), F.col("prefix"), F.col("middle"), F.col("suffix"), how.markers)
    return rows.select(*(F.col(f"__c{i}").alias(names[c]) for i, c in enumerate(keep)), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    chars = {f"{c}_chars": F.char_length(c).cast("long") for c in ("prefix", "middle")}
    return found.select("doc_id", "n", "form", *(c.alias(k) for k, c in chars.items()), sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
with units as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as d
  from documents),
hashed as (
  select *, len(u)::bigint as n, ('0x' || substr(d, 1, 8))::bigint as h1, ('0x' || substr(d, 9, 8))::bigint as h2, ('0x' || substr(d, 17, 8))::bigint as h3, ('0x' || substr(d, 25, 8))::bigint as h4
  from units),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from hashed),
parts as (
  select doc_id, t, n, form, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s
  from cuts)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) as output_sha256,
  sha256(case form when 'plain' then t else p || m || s end) as restored_sha256
from parts
"""
