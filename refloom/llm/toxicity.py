"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over words that labels single out. For each labelled sentence with an identity term, sentences
with that term swapped for others of its kind, and for a neutral word, are made; the fit penalises the squared change
of the score's log-odds, so a group's name does not count against the texts that mention it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.text import plain_words, rows_of

#: Identity terms by kind; a kind's terms may stand for each other. The first of a kind is its neutral word.
IDENTITY_TERMS: Mapping[str, Sequence[str]] = {
    "religion": "people muslims muslim christians christian jews jewish hindus hindu buddhists buddhist atheists atheist sikhs".split(),
    "gender": "person women woman men man girls girl boys boy transgender nonbinary".split(),
    "orientation": "people gay lesbian bisexual straight homosexual heterosexual queer".split(),
    "origin": "people black white asian latino african arab european american mexican chinese indian immigrants refugees foreigners natives".split(),
    "ability": "people deaf blind disabled autistic elderly young".split(),
    "de": "leute muslime christen juden frauen männer ausländer flüchtlinge schwule lesben schwarze weiße behinderte".split(),
    "fr": "gens musulmans chrétiens juifs femmes hommes immigrés réfugiés homosexuels lesbiennes noirs blancs handicapés".split(),
    "es": "gente musulmanes cristianos judíos mujeres hombres inmigrantes refugiados homosexuales lesbianas negros blancos discapacitados".split(),
}


@dataclass(frozen=True)
class ToxicityFit:
    """fit_rows and fit_chars bound the labelled texts that are fitted on (those with the least hash, which reach the driver); the rest are parameters of the fit."""

    fit_rows: int = 8192
    fit_chars: int = 64 << 20
    least_z: float = 3.0
    ridge: float = 0.02
    counterfactual: float = 1.0
    identity_terms: Mapping[str, Sequence[str]] | None = None


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: Mapping[bytes, float]

    def score(self, text: str | None) -> float:
        """Probability of the label from the set of words of the whole text; a text without words gets the bias alone."""
        odds = self.bias + sum(self.weights[w] for w in sorted(self.weights.keys() & set(plain_words(text))))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def swaps(text: str, terms: Mapping[str, Sequence[str]]) -> Iterator[tuple[set[bytes], set[bytes]]]:
    """Words of each sentence with an identity term, and of that sentence with the term swapped, for each other term of its kind."""
    kinds: dict[bytes, list[list[bytes]]] = {}
    for kind in terms.values():
        own = [t.encode() for t in kind]
        for t in own[1:]:
            kinds.setdefault(t, []).append(own)
    for sentence in _SENTENCE.split(text or ""):
        words = set(plain_words(sentence))
        for term in sorted(words & kinds.keys()):
            for kind in kinds[term]:
                for other in kind:
                    if other != term:
                        yield words, words - {term} | {other}


class _Cells:
    """A sparse matrix by its cells."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, width: int):
        self.rows, self.columns, self.values, self.height, self.width = rows, columns, values, height, width

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * v[self.columns], self.height)

    def back(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * u[self.rows], self.width)

    def squares(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values**2 * u[self.rows], self.width)


def _solve(curve: Callable[[np.ndarray], np.ndarray], slope: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """v with curve(v) = slope, curve being linear and positive definite with the diagonal scale, by conjugate gradients."""
    v, rest = np.zeros_like(slope), slope.copy()
    way = rest / scale
    size = first = float(rest @ way)
    for _ in range(10 * len(slope)):
        if size <= 1e-24 * first or size < 1e-300:
            break
        bent = curve(way)
        share = size / float(way @ bent)
        v += share * way
        rest -= share * bent
        after = float(rest @ (rest / scale))
        way = rest / scale + after / size * way
        size = after
    return v


def fit_toxicity(rows: Sequence[tuple[str | None, int]], how: ToxicityFit = ToxicityFit()) -> ToxicityModel:
    """A model from (text, label) rows. Equal texts count once, with their more frequent label (ties: 1).

    Words are taken whose log-odds between the labels, less least_z standard errors, don't touch 0, all of them.
    With rows of one label only, or none, every text gets that label's smoothed share.
    """
    votes: dict[str, list[int]] = {}
    for text, label in rows:
        votes.setdefault(text or "", [0, 0])[1 if label else 0] += 1
    texts = sorted(votes)
    y = np.array([votes[t][1] >= votes[t][0] for t in texts], float)
    n, n1 = len(texts), int(y.sum())
    prior = math.log((n1 + 0.5) / (n - n1 + 0.5))
    if n1 in (0, n):
        return ToxicityModel(prior, {})
    sets = [set(plain_words(t)) for t in texts]
    with_1, with_0 = Counter(), Counter()
    for words, label in zip(sets, y, strict=True):
        (with_1 if label else with_0).update(words)
    sure = []
    for word in with_1.keys() | with_0.keys():
        a, b = with_1[word], with_0[word]
        z = (math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n - n1 - b + 0.5))) / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if abs(z) >= how.least_z:
            sure.append((-abs(z), word))
    words = [w for _, w in sorted(sure)]
    at = {w: i for i, w in enumerate(words)}
    d = len(words)
    # the words of each text as (row, column); column d is the bias, of every row
    cells = [(i, at[w]) for i, own in enumerate(sets) for w in own & at.keys()]
    rows_at, columns = (np.array(c, np.int64) for c in zip(*sorted(cells))) if cells else (np.zeros(0, np.int64),) * 2
    x = _Cells(rows_at, columns, np.ones(len(cells)), n, d + 1)
    # every swap adds (change of the log-odds) ** 2; equal changes are summed up
    changes: Counter[tuple[tuple[int, float], ...]] = Counter()
    many = 0
    for text in texts:
        for one, other in swaps(text, how.identity_terms or IDENTITY_TERMS):
            many += 1
            if moved := tuple(sorted((at[w], s) for left, right, s in ((one, other, 1.0), (other, one, -1.0)) for w in left - right if w in at)):
                changes[moved] += 1
    moves = [(k, i, s) for k, moved in enumerate(sorted(changes)) for i, s in moved]
    change = _Cells(np.array([m[0] for m in moves], np.int64), np.array([m[1] for m in moves], np.int64), np.array([m[2] for m in moves]), len(changes), d + 1)
    weight = how.counterfactual * n / max(many, 1) * np.array([changes[m] for m in sorted(changes)], float)
    ridge = np.array([how.ridge] * d + [1e-6])
    w = np.zeros(d + 1)
    w[d] = prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + w[d], -500, 500)))
        q = p * (1 - p) + 1e-9

        def curve(v: np.ndarray, q=q) -> np.ndarray:
            u = q * (x.times(v) + v[d])
            out = x.back(u) + ridge * v + change.back(weight * change.times(v))
            out[d] += u.sum()
            return out

        slope = x.back(y - p) - ridge * w - change.back(weight * change.times(w))
        slope[d] += (y - p).sum()
        scale = x.back(q) + ridge + change.squares(weight)
        scale[d] += q.sum()
        step = _solve(curve, slope, scale)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(float(w[d]), {word: float(w[i]) for i, word in enumerate(words)})


def held_out(doc_id) -> F.Column:
    """Whether a row's label may not be learned from: crc32 of the id as text, modulo 3, is 1; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, how: ToxicityFit = ToxicityFit()) -> list[tuple[str, int]]:
    """At most fit_rows different (text, label) of documents with a label that is not held out, those with the least hash; of these, in the order of the hash, each that still has room in fit_chars characters: one that hasn't is left out, and the next are tried.

    The ids are bounded first, so what is broadcast is too. A document with several labels counts once for each.
    """
    own = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y")).distinct()
    own = own.orderBy(F.xxhash64("__id"), "__id", "__y").limit(how.fit_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("__id")).select(F.coalesce("text", F.lit("")).alias("t"), "__y")
    texts = texts.groupBy(F.xxhash64("t").alias("h"), "__y").agg(F.first("t").alias("t")).orderBy("h", "__y").limit(how.fit_rows)
    sizes = texts.select("h", "__y", F.length("t").alias("n")).collect()  # fit_rows at most
    chosen, left = [], how.fit_chars
    for r in sorted(sizes):
        if r.n <= left:
            chosen.append((r.h, r["__y"]))
            left -= r.n
    if len(chosen) < len(sizes):
        kept = docs.sparkSession.createDataFrame(chosen, "__h long, __k int")
        texts = texts.join(F.broadcast(kept), (F.col("h") == F.col("__h")) & (F.col("__y") == F.col("__k")), "left_semi")
    found = texts.orderBy("h", "__y").select("t", "__y").toArrow()
    return list(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """keep of every row of docs, with score and predicted (1 from threshold on); columns to keep can't have these names.

    Null and empty texts get the score of no words; repeated rows get equal scores; other columns play no part.
    """
    if clash := set(keep) & {"score", "predicted"}:
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([model.score(t) for (t,) in rows_of(batch, "__text")], pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(labelled_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_toxicity(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
