"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts, both bounded samples, train a linear
classifier on word presence in numpy. The risk of the unlabelled texts is
corrected by the class prior, and where the corrected part turns negative the
step goes against it. Terms are words and beginnings of words; those are chosen
whose document shares differ between the two samples, and Spark counts them.
Scoring is one pass over all texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import written
from .tables import as_strings, collected, fresh, rows_of

_WORD = re.compile(r"[^\W\d_]+")
_ROWS = 2_000
PREFIXES = (4, 6)               # letters of a beginning


@dataclass(frozen=True)
class Training:
    """Bounds of the two samples and settings of the optimiser."""

    positives: int = 4_000          # confirmed toxic texts, by hash of the id
    unlabelled: int = 12_000        # texts without regard to labels, by hash of the id
    terms: int = 1_024              # most terms the classifier knows
    least_z: float = 5.0            # least difference of a term's shares, in standard errors
    least_texts: int = 5            # least number of sampled texts with the term
    steps: int = 400
    rate: float = 0.1
    decay: float = 1e-4
    prior: float = 0.1              # share of toxic texts where no labels tell it
    seed: int = 7


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        """Probability between 0 and 1; a text without known terms has the bias alone."""
        found = terms(text) & self.weights.keys() if text else ()
        margin = self.bias + sum(self.weights[t] for t in sorted(found))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, margin))))


def terms(text: str) -> set[str]:
    """Distinct lower-cased runs of letters and the beginnings of longer ones.

    A beginning is marked by a hyphen, one that two or more distinct words share
    by a second hyphen as well.
    """
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for n in PREFIXES:
        once: set[str] = set()
        twice: set[str] = set()
        for start in [w[:n] for w in words if len(w) > n]:
            (twice if start in once else once).add(start)
        out.update([f"{x}-" for x in once])
        out.update([f"{x}--" for x in twice])
    return out


def held_out(doc_id: str | Column) -> Column:
    """Rows that no label is learned from; a NULL id is not held out, as it has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def non_negative_risk(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], n_terms: int, prior: float, training: Training,
) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative PU risk with logistic loss; rows are arrays of term numbers."""
    rows = positive + unlabelled
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_p = np.arange(len(rows)) < len(positive)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    w, bias = np.zeros(n_terms), math.log(prior / (1 - prior))
    m, v = np.zeros(n_terms + 1), np.zeros(n_terms + 1)
    for step in range(1, training.steps + 1):
        margin = bias + np.bincount(owner, w[flat], len(rows))
        chance = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        as_negative = np.logaddexp(0, margin)                 # loss of calling a row clean
        rest = as_negative[~is_p].sum() / n_u - prior * as_negative[is_p].sum() / n_p
        # derivative of the risk by each row's margin
        slope = np.where(is_p, prior * (chance - 1) / n_p, 0.0)
        unlabelled_part = np.where(is_p, -prior * chance / n_p, chance / n_u)
        slope = slope + unlabelled_part if rest >= 0 else -unlabelled_part
        gradient = np.append(np.bincount(flat, slope[owner], n_terms) + training.decay * w, slope.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient * gradient
        move = training.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def _sampled(docs: DataFrame, labels: DataFrame, training: Training, doc_id: str, text: str) -> DataFrame:
    """(id, toxic, terms) of both samples; a text may be in both. Only ids that are not held out take part."""
    order = F.xxhash64("id", F.lit(training.seed))
    positive = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull()).where(~held_out("doc_id")).select(
        F.col("doc_id").alias("id")).distinct().orderBy(order, "id").limit(training.positives)
    anyone = docs.select(F.col(doc_id).alias("id")).where("id IS NOT NULL").where(~held_out("id")).distinct().orderBy(
        order, "id").limit(training.unlabelled)
    picks = F.broadcast(positive.select("id", F.lit(True).alias("toxic")).unionByName(
        anyone.select("id", F.lit(False).alias("toxic"))).withColumnRenamed("id", "picked"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(
        picks, F.col("id") == F.col("picked")).select("id", "toxic", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, _ROWS):
            found = [sorted(terms(t)) if t else [] for t in as_strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["id", "toxic", "terms"])

    stored = written(rows.mapInArrow(read, "id bigint, toxic boolean, terms array<string>"))
    # repeated ids count once, so that many copies of one row weigh no more than it
    return stored.groupBy("id", "toxic").agg(F.min("terms").alias("terms"))


def learn(
    docs: DataFrame, labels: DataFrame, training: Training = Training(), doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """Classifier and class prior from the rows that are not held out; without toxic rows the prior alone."""
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id")).agg(
        F.count_if(F.col("toxic") == 1).alias("p"), F.count("*").alias("n")).first()
    prior = told.p / told.n if told.p and told.p < told.n else training.prior
    sample = written(_sampled(docs, labels, training, doc_id, text))
    sizes = sample.agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("u")).first()
    if not sizes.p or not sizes.u:
        return Model({}, math.log(prior / (1 - prior)))
    counts = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("u"))
    a, b = F.col("p") / sizes.p, F.col("u") / sizes.u
    both = (F.col("p") + F.col("u")) / (sizes.p + sizes.u)
    z = F.abs(a - b) / F.sqrt(both * (1 - both) * (1 / sizes.p + 1 / sizes.u) + 1e-12)
    chosen = counts.where(F.col("p") + F.col("u") >= training.least_texts).withColumn("z", z).where(
        F.col("z") >= training.least_z).orderBy(F.desc("z"), "term").limit(training.terms)
    vocabulary = {r.term: k for k, r in enumerate(collected(chosen, training.terms, "terms"))}
    known = F.array_intersect("terms", F.lit(list(vocabulary) or [""]))
    rows = collected(sample.select("id", "toxic", known.alias("w")), training.positives + training.unlabelled, "sample")
    rows.sort(key=lambda r: (not r.toxic, r.id))
    numbered = [np.array([vocabulary[x] for x in r.w if x in vocabulary], np.int64) for r in rows]
    w, bias = non_negative_risk(numbered[:sizes.p], numbered[sizes.p:], len(vocabulary), prior, training)
    return Model({x: float(w[k]) for x, k in vocabulary.items()}, float(bias))


def with_score(docs: DataFrame, model: Model, out: str, text: str = "text", most: float | None = None) -> DataFrame:
    """All columns of ``docs`` and the score of each whole text; only rows with less than ``most`` if that is given."""
    names = docs.columns
    at = names.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, _ROWS):
            scores = pa.array([model.score(t) for t in as_strings(batch.column(at))], pa.float64())
            scored = pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*names, out])
            yield scored if most is None else scored.filter(pc.less(scores, most))

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def score_documents(
    docs: DataFrame, labels: DataFrame, training: Training = Training(), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    NULL and empty texts get the score of a text without known terms. An empty
    label table leaves the prior as every score. Repeated rows are scored each.
    """
    model = learn(docs, labels, training, doc_id, text)
    rows = with_score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, "score")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(
    docs: DataFrame, labels: DataFrame, training: Training = Training(), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    model = learn(docs, labels, training, doc_id, text)
    out = fresh(docs, "score")[0]
    return with_score(docs, model, out, text, most=0.5).select(*docs.columns)
