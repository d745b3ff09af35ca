"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are held against reference histograms of
its language by Jensen-Shannon distance. Rules on counts (too short, mostly repeated) come first. References are measured
on a bounded sample of documents labelled good, language by language, and shrunk towards built-in ones by their number, so
that they move smoothly from these to what is measured. Given the references, each verdict depends on its own row only: one
pass, no shuffle, nothing kept between rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.llm.shared import materialize
from refloom.llm.text import lean, rows_of

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "other")
#: Shares of character classes in running text, near enough alike in the four languages.
CLASS_SHARES = {
    "en": (0.785, 0.025, 0.010, 0.150, 0.025, 0.005),
    "de": (0.790, 0.035, 0.010, 0.135, 0.025, 0.005),
    "fr": (0.780, 0.025, 0.010, 0.150, 0.028, 0.007),
    "es": (0.785, 0.025, 0.010, 0.150, 0.025, 0.005),
}
#: Common words of each language, most frequent first; every other word counts as one further class.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on as with be by this are from at or not have an they which you his but he".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou elle aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
#: Share of all common words together in running text.
COMMON_SHARE = 0.40


@dataclass(frozen=True)
class Reference:
    """What text of a language looks like: shares of CLASSES, and the shares of some words (the rest is one class); documents: how many it was measured on."""

    classes: Sequence[float]
    words: Mapping[str, float]
    documents: int = 0


def zipf_reference(lang: str) -> Reference:
    """The built-in reference: the r-th common word has a share in proportion to 1 / (r + 1)."""
    words = COMMON_WORDS[lang]
    total = sum(1 / (r + 2) for r in range(len(words)))
    return Reference(CLASS_SHARES[lang], {w: COMMON_SHARE / (r + 2) / total for r, w in enumerate(words)})


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules. max_*: Jensen-Shannon distances (base 2, 0 to 1); min_*: shorter texts skip that comparison."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_class_distance: float = 0.17
    min_chars: int = 200
    max_word_distance: float = 0.40
    min_common_words: int = 80
    references: Mapping[str, Reference] = field(default_factory=lambda: {k: zipf_reference(k) for k in COMMON_WORDS})


def jensen_shannon(p: Sequence[float], q: Sequence[float]) -> float:
    """Square root of the Jensen-Shannon divergence to base 2; both are made to sum to 1, and the distance to nothing is 1."""
    a, b = sum(p), sum(q)
    if a <= 0 or b <= 0:
        return 0.0 if a == b else 1.0
    total = 0.0
    for x, y in zip(p, q, strict=True):
        x, y = x / a, y / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(total / 2, 0))


#: Languages whose samples are broadcast together; with more, Spark chooses how to join.
MOST_BROADCAST = 256


def good_sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """__id: of each language, the documents labelled good (quality 1) with the least hash of their id, fit_rows at most."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    own = docs.where("lang is not null").select("doc_id", F.col("lang").cast("string").alias("__lang")).join(good, F.col("doc_id") == F.col("__id")).select("__id", "__lang").distinct()
    own = materialize(own, "quality-good")
    many = own.groupBy(F.col("__lang").alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    # a share by hash first, so that what is put in order is bounded too
    share = F.shiftrightunsigned(F.xxhash64("__id"), 11) / F.lit(float(1 << 53))
    some = own.join(many, F.col("__lang") == F.col("__l")).where(share * F.col("__n") < 2 * fit_rows + 100)
    ranked = some.withColumn("__r", F.row_number().over(Window.partitionBy("__lang").orderBy(F.shiftrightunsigned(F.xxhash64("__id"), 11), "__id")))
    sample = materialize(ranked.where(F.col("__r") <= fit_rows).select("__id").distinct(), "quality-sample")
    return F.broadcast(sample) if many.count() <= MOST_BROADCAST else sample


def fit_references(docs: DataFrame, labels: DataFrame, fit_rows: int = 4096, least_documents: int = 100, most_words: int = 30, also: Mapping[str, Sequence[str]] | None = None) -> dict[str, Reference]:
    """References of the languages of docs that have least_documents or more of good_sample, from their pooled histograms.

    Their words are the most_words most frequent ones, and those of also by language. Each partition counts its own
    words; these words of each language reach the driver.
    """
    good = good_sample(docs, labels, fit_rows)
    rows = docs.select("doc_id", "lang", "text").where("lang is not null").join(good, F.col("doc_id") == F.col("__id"), "left_semi").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for text, lang in rows_of(batch, "text", "lang"):
                data = (text or "").encode("utf-8", "surrogatepass")
                words.update((lang, w.decode("utf-8", "replace")) for w in data.lower().translate(_NOT_LETTERS_TO_SPACE).split())
                # class names can't be words: these have no spaces
                words.update({(lang, f"class {k}"): n for k, n in zip(CLASSES, class_histogram(text or "", data), strict=True)} | {(lang, "all documents"): 1})
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in words], pa.string()), "word": pa.array([k[1] for k in words], pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    counts = rows.mapInArrow(lean(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "quality-words")
    special = F.contains("word", F.lit(" "))
    totals = counts.where(~special).groupBy("lang").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    wanted = F.lit(False)
    for lang, words in (also or {}).items():
        wanted = wanted | ((F.col("lang") == lang) & F.col("word").isin(*words))
    top = counts.where(~special).withColumn("r", F.row_number().over(order)).where((F.col("r") <= most_words) | wanted).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    classes = counts.where(special).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("classes"))
    classes = classes.where(F.try_element_at("classes", F.lit("all documents")) >= least_documents)
    found = {}
    for r in classes.join(totals, "lang").join(top, "lang").collect():  # a language needs least_documents of the sample: there are few
        chars = sum(r.classes.get(f"class {k}", 0) for k in CLASSES)
        found[r.lang] = Reference(tuple(r.classes.get(f"class {k}", 0) / chars for k in CLASSES), {x.word: x.n / r.total for x in r.top}, r.classes["all documents"])
    return found


def blend(measured: Reference, prior: Reference, prior_documents: int) -> Reference:
    """The mean of both, weighed by the number of documents: the prior counts as prior_documents."""
    w = measured.documents / (measured.documents + prior_documents)
    mixed = lambda a, b: w * a + (1 - w) * b
    words = {x: mixed(measured.words.get(x, 0.0), prior.words.get(x, 0.0)) for x in sorted(measured.words.keys() | prior.words.keys())}
    return Reference(tuple(map(mixed, measured.classes, prior.classes)), words, measured.documents)


def rules_for(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules(), prior_documents: int = 100) -> QualityRules:
    """The rules with the references of rules blended with what docs and labels say, each language by its number of documents.

    A language that the rules have no reference for gets one from prior_documents on: below, it is compared by character
    classes with the nearest only, as any language without reference.
    """
    own = {lang: list(r.words) for lang, r in rules.references.items()}
    found = fit_references(docs, labels, least_documents=1, also=own)
    new = {lang: blend(r, rules.references[lang], prior_documents) if lang in rules.references else r for lang, r in found.items() if lang in rules.references or r.documents >= prior_documents}
    return replace(rules, references={**rules.references, **new})


def repeated_words(words: list) -> int:
    """How many of the words stand in a 3-word window that occurs twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, until = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def repeated_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


_ASCII = bytes(range(128))
_NOT_LETTERS_TO_SPACE = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_STOPS = b".,;:!?'\"()-"
#: The class of each ASCII byte; other bytes count for none.
_OF_BYTE = np.array([[b < 128 and kind == ("lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "space" if b in b" \t\n\v\f\r" else "stop" if b in _STOPS else "other") for kind in CLASSES] for b in range(256)], np.int64)


def class_histogram(text: str, data: bytes) -> list[int]:
    """Counts of CLASSES in characters; data is the text in UTF-8."""
    counts = dict(zip(CLASSES, (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _OF_BYTE).tolist(), strict=True))
    if len(data) > len(text):
        for ch, n in Counter(data.translate(None, _ASCII).decode("utf-8", "surrogatepass")).items():
            counts["upper" if ch.isupper() else "lower" if ch.isalpha() else "digit" if ch.isdigit() else "space" if ch.isspace() else "other"] += n
    return list(counts.values())


def measure(text: str | None, lang: str | None, rules: QualityRules) -> dict:
    """Counts, distances and verdict for one text. A null text counts as an empty one.

    A language without reference, or none, is compared by character classes with the nearest reference only.
    """
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    out = {
        "n_words": n,
        "word_chars": len(text) - (len(data) - len(data.translate(None, b" \t\n\v\f\r"))),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": repeated_lines(data),
        "n_repeat_words": repeated_words(words),
        "class_distance": None,
        "word_distance": None,
    }
    out["base_failed"] = n < rules.min_words or 100 * out["n_repeat_words"] > rules.max_repeat_percent * n
    if not rules.references:
        return out | {"kept": not out["base_failed"]}
    own = rules.references.get(lang)
    kept = not out["base_failed"]
    if len(text) >= rules.min_chars:
        found = class_histogram(text, data)
        out["class_distance"] = min(jensen_shannon(found, r.classes) for r in ([own] if own else rules.references.values()))
        kept = kept and out["class_distance"] <= rules.max_class_distance
    if own and n >= rules.min_common_words:
        counts = Counter(data.lower().translate(_NOT_LETTERS_TO_SPACE).split())
        common = [counts[w.encode()] for w in own.words]
        shares = list(own.words.values())
        out["word_distance"] = jensen_shannon([*common, max(counts.total() - sum(common), 0)], [*shares, 1 - sum(shares)])
        kept = kept and out["word_distance"] <= rules.max_word_distance
    return out | {"kept": kept}


_FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "class_distance": "double", "word_distance": "double", "base_failed": "boolean", "kept": "boolean"}


def score_quality(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", lang: str = "lang", rules: QualityRules | None = None) -> DataFrame:
    """The columns keep of docs, and after them the counts, distances and verdict of each row's whole text.

    Null and empty texts have zero words and fail the base rules; a table without the column lang is compared as one
    without languages; repeated rows get equal rows; an empty table gives an empty one. Columns of docs that are not in
    keep play no part, so their names cannot clash; those in keep must not have a name of the result.
    """
    rules = rules or QualityRules()
    keep = list(keep)
    if clash := set(keep) & set(_FIELDS):
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"), (F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")).alias("__lang"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]), *(f"{k} {v}" for k, v in _FIELDS.items())])
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t, g, rules) for t, g in rows_of(batch, "__text", "__lang")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array([x[k] for x in found], kinds[v]) for k, v in _FIELDS.items())], names=[*keep, *_FIELDS])

    return rows.mapInArrow(lean(run), schema)


def filter_quality(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    names = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    of = {n: f"c{i}" for i, n in enumerate(names)}
    kept = score_quality(renamed, renamed.columns, of["text"], of.get("lang", "lang"), rules).where("kept")
    return kept.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, rules=rules_for(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs, rules_for(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
