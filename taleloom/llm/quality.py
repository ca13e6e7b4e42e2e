"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; all documents of the training fold
serve as unlabelled web text; labels of 0 are never used as negatives, only in
the estimate of the class prior (the share of label 1 among training labels,
which can be given instead). A linear model on a few text statistics minimises
the non-negative unbiased risk with logistic loss,

    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) + penalty,

by Newton steps. A step that would make the second term negative, by more than the
error of an estimate from so many positives, is halved until it does not, so the
model never fits the unlabelled rows below the risk that their negatives must have. Each step is one pass over all rows of the fold: tasks sum
gradient and Hessian, and a few hundred numbers reach the driver. No rows are
sampled.

A text is described by character classes, words and lines only; id, source,
language and labels are never inputs of a score.

Defined results: null and empty texts have statistics of zero and are scored like
any other; rows of a null id are unlabelled; a document labelled more than once
is a positive if one label is 1; null labels are ignored; without trusted
positives every score is the prior, and without labels 0.5; repeated rows each
get a row; an empty table gives no rows; other columns are ignored, or kept by
``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.llm.textbytes import text_slices
from taleloom.session import cut_lineage

FOLDS = 5
THRESHOLD = 0.3
PENALTY = 1e-2
PASSES = 20
SLACK = 0.5
LONGEST_STEP = 2.0

LOWER, UPPER, DIGIT, LEAD, MORE, PIPE, SYMBOL, SHOUT, STOP, LINE = range(1, 11)
CLASSES = 16
STATISTICS = 13
KIND = np.zeros(256, "i8")
KIND[ord("a") : ord("z") + 1] = LOWER
KIND[ord("A") : ord("Z") + 1] = UPPER
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[0xC0:] = LEAD
KIND[0x80:0xC0] = MORE
for _char, _kind in [("|", PIPE), ("!", SHOUT), (",", STOP), (".", STOP), ("\n", LINE)] + [(c, SYMBOL) for c in "#$%&*@<>{}[]=_~^+\\/"]:
    KIND[ord(_char)] = _kind


def text_statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    blocks = [np.zeros((0, STATISTICS))]
    for _, data, offsets in text_slices(texts):
        n = len(offsets) - 1
        owner = np.repeat(np.arange(n) * CLASSES, np.diff(offsets))
        c = np.bincount(owner + KIND[data], minlength=n * CLASSES).reshape(n, CLASSES).astype("f8")
        raw = data.tobytes()
        words, kinds, again, lines, line_kinds = np.zeros((5, n))
        for i in range(n):
            text = raw[offsets[i] : offsets[i + 1]]
            parts = text.split()
            words[i], kinds[i], again[i] = len(parts), len(set(parts)), sum(map(eq, parts, parts[1:]))
            parts = text.split(b"\n")
            lines[i], line_kinds[i] = len(parts), len(set(parts))
        chars = np.diff(offsets) - c[:, MORE]
        letters = c[:, LOWER] + c[:, UPPER] + c[:, LEAD]
        some, each = np.maximum(chars, 1), np.maximum(words, 1)
        blocks.append(
            np.stack(
                [
                    np.log1p(chars),
                    letters / some,
                    c[:, UPPER] / np.maximum(letters, 1),
                    c[:, DIGIT] / some,
                    np.log1p(c[:, PIPE] / each),
                    np.log1p((c[:, SYMBOL] + c[:, PIPE]) / each),
                    np.log1p(c[:, SHOUT] / each),
                    np.log1p(c[:, STOP] / each),
                    kinds / each,
                    again / each,
                    np.log1p(lines / each),
                    line_kinds / lines,
                    np.log1p(chars / each),
                ],
                axis=1,
            )
        )
    return np.concatenate(blocks)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _described(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype="i4") * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last is the constant

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_with_constant((x - self.centre) / self.spread) @ self.weights)


def _with_constant(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def _sums(model: Model):
    """Per task: sums over unlabelled rows and over positives, as one list of numbers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            a = _with_constant((_matrix(batch.column(0)) - model.centre) / model.spread)
            f = np.clip(a @ model.weights, -500, 500)
            s, negative = _sigmoid(f), np.logaddexp(0, f)
            p = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            parts = [[len(f), p.sum(), negative.sum(), negative[p].sum()], a.T @ s, a[p].sum(axis=0)]
            now = np.concatenate([*parts, ((a * (s * (1 - s))[:, None]).T @ a).ravel()])
            total = now if total is None else total + now
        if total is not None:
            at = pa.array(np.arange(len(total)))
            yield pa.RecordBatch.from_arrays([at, pa.array(total)], names=["at", "value"])

    return scan


def fit(rows: DataFrame, prior: float, penalty: float = PENALTY, passes: int = PASSES) -> Model | None:
    """The model for unlabelled rows ``x, positive``; ``None`` without positives."""
    n = rows.agg(F.max(F.size("x"))).first()[0]
    if not n or not rows.filter("positive").limit(1).count():
        return None
    stats = [f(F.col("x")[i]) for i in range(n) for f in (F.avg, F.stddev_pop)]
    moments = np.array(rows.agg(*stats).first(), "f8").reshape(n, 2)
    model = Model(moments[:, 0], np.where(moments[:, 1] > 0, moments[:, 1], 1.0), np.zeros(n + 1))
    d = n + 1
    feasible, step = model.weights, np.zeros(d)
    for _ in range(passes):
        sums = rows.select("x", "positive").mapInArrow(_sums(model), "at long, value double")
        got = sums.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
        v = np.array([r["value"] for r in got])
        n_u, n_p, risk_u, risk_p = v[:4]
        if risk_u / n_u - prior * risk_p / n_p < -SLACK / np.sqrt(n_p):
            step = step / 2
        else:
            feasible = model.weights
            from_u, mean_p = v[4 : 4 + d] / n_u, v[4 + d : 4 + 2 * d] / n_p
            hessian = v[4 + 2 * d :].reshape(d, d) / n_u + penalty * np.eye(d)
            step = -np.linalg.solve(hessian, from_u - prior * mean_p + penalty * feasible)
            step *= min(1.0, LONGEST_STEP / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
        model = Model(model.centre, model.spread, feasible + step)
    return Model(model.centre, model.spread, feasible)


def _prior(labels: DataFrame) -> float:
    share = labels.filter(~held_out() & F.col("quality").isNotNull()).agg(F.avg("quality")).first()[0]
    return 0.5 if share is None else float(share)


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[Model | None, float, DataFrame]:
    """The model, the class prior, and the stored statistics ``doc_id, x`` of all rows."""
    prior = _prior(labels) if prior is None else prior
    described = cut_lineage(_described(docs))
    trusted = labels.filter(~held_out() & (F.col("quality") == 1)).select("doc_id").distinct()
    rows = described.filter(~held_out()).join(trusted.withColumn("positive", F.lit(True)), "doc_id", "left")
    rows = cut_lineage(rows.select("x", F.coalesce("positive", F.lit(False)).alias("positive")))
    return fit(rows, prior), prior, described


def _scored(model: Model | None, prior: float, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), prior) if model is None else model.scores(x)


def score(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """``doc_id, score`` of every row: the probability of label 1."""
    model, prior, described = train(docs, labels, prior)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(_scored(model, prior, _matrix(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return described.mapInArrow(scan, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, prior: float | None = None) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; every column is kept."""
    model, prior, _ = train(docs, labels, prior)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _scored(model, prior, text_statistics(batch.column(at))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
