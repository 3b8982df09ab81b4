"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic documents carry a label; everything else is unlabelled
text that holds some toxic documents too. A linear numpy classifier over word
counts is trained with the risk estimator corrected by the class prior,

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),

whose second term estimates the risk of the clean part of the unlabelled text
and is kept from going below zero: in steps where it does, the gradient of that
term is followed upwards instead.

Marks are words and their first letters (families of compound words share
these); their values are logarithms of their counts in the whole text, scaled to a vector
of fixed length. The classifier is fitted on a bounded sample (``max_positive`` confirmed and
``max_unlabelled`` unlabelled documents, in expectation, chosen by a hash of the
id, so reruns agree). Document counts of the sample are aggregated by Spark; every
mark of at least ``min_docs`` confirmed documents that a two-proportion test finds commoner
there (``min_clear``) takes part, however rare it is, and the sample's values for these marks
reach the driver as a sparse matrix. Both are bounded by the sample. Every document is then
scored over its whole text.

Defined cases: a null text is an empty one; an empty text gets the score of no
mark. A null doc_id counts as the empty string in the held-out rule. Repeated
rows are scored each on its own, alike for equal texts. Without confirmed toxic
documents all scores are the class prior (0 without labels). Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share, modest_batches, settled

#: A word: a run of letters, in lower case.
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as marks beside whole words.
STEMS = (4, 6)
#: Length of a text's vector of values: many marks don't outweigh few by their number alone.
LENGTH = 4.0
#: Marks that a task counts before it passes the counts on.
HELD = 50_000


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


class Sparse:
    """A matrix by its cells."""

    def __init__(self, rows, columns, values, n: int, width: int):
        self.rows, self.columns = np.asarray(rows, np.int64), np.asarray(columns, np.int64)
        self.values, self.n, self.width = np.asarray(values, float), n, width

    def __len__(self) -> int:
        return self.n

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * g[self.rows], self.width)


def _sparse(x) -> Sparse:
    if isinstance(x, Sparse):
        return x
    rows, columns = np.nonzero(x)
    return Sparse(rows, columns, x[rows, columns], *x.shape)


def fit_nnpu(pos, unl, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4,
             seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier; sigmoid loss l(z) = s(-z), which is
    bounded, so a few odd documents don't move it; full-batch Adam. ``pos``, ``unl``:
    ``Sparse`` or arrays."""
    pos, unl = _sparse(pos), _sparse(unl)
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 0.01, pos.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def mean_back(x: Sparse, g: np.ndarray) -> np.ndarray:
        return np.append(x.back(g), g.sum()) / len(x)

    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x.times(w[:-1]) + w[-1], -30, 30))) for x in (pos, unl))
        towards_p = prior * mean_back(pos, sp * (1 - sp))
        clean = mean_back(unl, su * (1 - su)) - towards_p
        clean_risk = su.mean() - prior * sp.mean()
        grad = clean - towards_p if clean_risk >= 0 else -clean
        grad = grad + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def marks_of(word: str) -> list[str]:
    """A word, and its first letters, so that a family of words counts as one."""
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]


def _document_counts(sample: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """In how many documents each mark stands: ``mark, n``. Counted per task first."""

    def count(batches):
        n = Counter()
        for batch in batches:
            for t in batch["text"]:
                found = {m for w in set(WORD.findall((t or "").lower())) for m in marks_of(w)}
                n.update(found if only is None else found & only)
                if len(n) > HELD:  # what a task holds stays bounded; the sums meet after the shuffle
                    yield pd.DataFrame(list(n.items()), columns=["mark", "n"])
                    n.clear()
        yield pd.DataFrame(list(n.items()), columns=["mark", "n"])

    return (sample.select("text").mapInPandas(count, "mark string, n long")
            .groupBy("mark").agg(F.sum("n").alias("n")))


class Reader:
    """Weighed marks of texts. Keeps which marks a word has, for a bounded number of words."""

    def __init__(self, place: dict[str, int], keep: int = 150_000):
        self.place, self.keep, self.known = place, keep, {}

    def counts(self, text: str | None) -> dict[int, int]:
        words = WORD.findall((text or "").lower())
        if len(self.known) > self.keep:
            self.known.clear()
        known, place = self.known, self.place
        for w in [w for w in set(words) if w not in known]:
            known[w] = tuple(place[m] for m in marks_of(w) if m in place)
        found: dict[int, int] = {}
        for marks in filter(None, map(known.__getitem__, words)):
            for i in marks:
                found[i] = found.get(i, 0) + 1
        return found

    def values(self, text: str | None) -> dict[int, float]:
        found = {i: math.log2(1 + n) for i, n in sorted(self.counts(text).items())}
        length = math.sqrt(math.fsum(x * x for x in found.values()))
        return {i: LENGTH * x / length for i, x in found.items()}


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 4_000, max_unlabelled: int = 10_000,
          min_docs: int = 3, min_clear: float = 5.0, class_prior: float | None = None) -> Model:
    """Fit on the rows of ``docs`` and ``labels`` that are not held out.
    ``class_prior``: share of toxic documents; by default that among the
    labelled training rows."""
    marks = (labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic")))
    n_marked, n_pos = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = class_prior if class_prior is not None else (n_pos / n_marked if n_marked else 0.0)
    outside = Model(bias=math.log(prior / (1 - prior)) if 0 < prior < 1 else (-40.0 if prior <= 0 else 40.0))
    if not n_pos:
        return outside
    ids = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id")
    n_docs = ids.count()
    if not n_docs:
        return outside
    chance = hash_share(F.lit("toxicity"), F.col("doc_id"))
    chosen = (marks.where((F.col("toxic") == 1) & (chance < F.lit(max_positive / n_pos)))
              .select("doc_id", F.lit(1).alias("positive"))
              .unionByName(ids.distinct().where(chance < F.lit(max_unlabelled / n_docs))
                           .select("doc_id", F.lit(0).alias("positive"))))
    texts = docs.select("doc_id", "text")
    # at most about max_positive + max_unlabelled ids
    picked = chosen.groupBy("doc_id").agg(F.max("positive").alias("positive"),
                                          F.max(1 - F.col("positive")).alias("unlabelled"))
    sample = settled(texts.join(F.broadcast(picked), "doc_id")
                     .select("doc_id", "text", "positive", "unlabelled"))
    n_p, n_u = sample.agg(F.coalesce(F.sum("positive"), F.lit(0)), F.coalesce(F.sum("unlabelled"), F.lit(0))).first()
    if not n_p or not n_u:
        return outside
    # at most 1/min_docs of all marks of the sampled confirmed documents
    common = {r.mark: r.n for r in _document_counts(sample.where("positive = 1"), None)
              .where(F.col("n") >= min_docs).collect()}
    elsewhere = {r.mark: r.n for r in _document_counts(sample.where("unlabelled = 1"), frozenset(common)).collect()}

    def clear(mark: str) -> float:
        """Two-proportion test: is the mark commoner in the confirmed documents?"""
        p, u = common[mark], elsewhere.get(mark, 0)
        both = (p + u) / (n_p + n_u)
        spread = math.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
        return (p / n_p - u / n_u) / spread if spread else 0.0

    vocabulary = sorted(w for w in common if clear(w) >= min_clear)
    place = {w: i for i, w in enumerate(vocabulary)}

    @F.pandas_udf("map<int,double>")
    def numbers(texts: pd.Series) -> pd.Series:
        reader = Reader(place)
        return texts.map(reader.values)

    rows = sample.select("doc_id", "positive", "unlabelled", numbers("text").alias("found")).collect()
    rows.sort(key=lambda r: (r.doc_id, sorted(r.found.items())))

    def matrix(picked_rows) -> Sparse:
        cells = [(i, j, value) for i, r in enumerate(picked_rows) for j, value in r.found.items()]
        return Sparse(*(zip(*cells) if cells else ((), (), ())), len(picked_rows), len(vocabulary))

    w, bias = fit_nnpu(matrix([r for r in rows if r.positive]), matrix([r for r in rows if r.unlabelled]), prior)
    return Model(bias, {word: float(w[i]) for word, i in place.items()})


def score(text: Column, model: Model) -> Column:
    """Probability, 0 to 1, that ``text`` is toxic."""
    place = {m: i for i, m in enumerate(model.weights)}
    weights, bias = list(model.weights.values()), model.bias

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        reader, out = Reader(place), []
        for t in texts:
            z = bias + math.fsum(weights[i] * v for i, v in reader.values(t).items())
            out.append(1 / (1 + math.exp(-min(max(z, -40.0), 40.0))))
        return pd.Series(out, dtype="float64")

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    modest_batches(docs.sparkSession)
    model = train(docs, labels, **options)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept."""
    modest_batches(docs.sparkSession)
    model = train(docs, labels, **options)
    return docs.where(score(F.col("text"), model) < 0.5)
