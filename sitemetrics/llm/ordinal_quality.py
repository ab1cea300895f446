"""Quality classifier: ordinal regression with cumulative links on hashed text.

P(grade <= k) = 1 / (1 + exp(f - threshold_k)) with one linear score f for all grades and ascending thresholds. f is a mean over the
text's tokens of weights of three hashed features: the lower-cased token, its shape, and whether it repeats the token before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.labelled import labelled_sample, shapes
from sitemetrics.llm.texts import NOT_SPACE, slices, words

BUCKET_BITS = 17
FIT_ROWS = 6000
EPOCHS = 12
BATCH = 64
RATE = 0.5
MOST_GRADES = 100
_SALT = np.uint64(0x2545F4914F6CDD1D)


@dataclass
class OrdinalModel:
    """`grades` ascending; `thresholds[k]` parts grades[k] from grades[k + 1]. 2**BUCKET_BITS weights, whatever the corpus."""

    grades: list[int]
    thresholds: np.ndarray
    weights: np.ndarray


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets for each token, and each text's first token (n + 1)."""
    w, s = words(column, NOT_SPACE), shapes(column)
    top = np.uint64(64 - BUCKET_BITS)
    again = np.zeros(len(w.hash), np.int64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    return np.stack([w.hash >> top, (s.hash * _SALT) >> top, again], axis=1).astype(np.int32), w.first


def _scores(features: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text; 0 for one without tokens."""
    total = np.concatenate([[0.0], np.cumsum(weights[features].sum(axis=1))])
    n = np.diff(first)
    return np.where(n > 0, (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1), 0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _fit(levels: int):
    """AdaGrad on the log likelihood of the cumulative links; thresholds are a first one and positive steps, so they stay in order."""

    def run(batches):
        rows = [r for b in batches for r in zip(b.column("id").to_pylist(), b.column("level").to_pylist(), b.column("features").to_pylist(), strict=True)]
        if not rows:
            return
        rows.sort(key=lambda r: (r[0], r[1], r[2]))
        docs = [np.frombuffer(f, np.int32).reshape(-1, 3) for _, _, f in rows]
        level = np.array([y for _, y, _ in rows])
        weights, seen = np.zeros(1 << BUCKET_BITS), np.full(1 << BUCKET_BITS, 1e-6)
        share = np.clip(np.cumsum(np.bincount(level, minlength=levels))[:-1] / len(level), 1e-3, 1 - 1e-3)
        cut = np.log(share / (1 - share))
        steps = np.append(cut[:1], np.log(np.maximum(np.diff(cut), 1e-2)))
        steps_seen = np.full(levels - 1, 1e-2)
        shuffle = np.random.default_rng(5)
        for _ in range(EPOCHS):
            order = shuffle.permutation(len(docs))
            for lo in range(0, len(order), BATCH):
                pick = order[lo : lo + BATCH]
                first = np.append(0, np.cumsum([len(docs[i]) for i in pick]))
                x, y = np.concatenate([docs[i] for i in pick]), level[pick]
                f = _scores(x, first, weights)
                theta = np.append(steps[0], steps[0] + np.cumsum(np.exp(steps[1:])))
                below = _sigmoid(np.concatenate([[-np.inf], theta, [np.inf]])[None, :] - f[:, None])
                p = np.maximum(below[np.arange(len(y)), y + 1] - below[np.arange(len(y)), y], 1e-9)
                slope = below * (1 - below)
                up, down = slope[np.arange(len(y)), y + 1], slope[np.arange(len(y)), y]
                by_f = (down - up) / p
                n = np.maximum(np.diff(first), 1)
                grad = -np.bincount(x.ravel(), np.repeat(by_f / n, np.diff(first) * 3), 1 << BUCKET_BITS) / len(y)
                seen += grad**2
                weights -= RATE * grad / np.sqrt(seen)
                by_theta = np.zeros(levels + 1)
                np.add.at(by_theta, y + 1, up / p)
                np.add.at(by_theta, y, -down / p)
                after = np.cumsum(by_theta[1:-1][::-1])[::-1] / len(y)
                move = -after * np.append(1.0, np.exp(steps[1:]))
                steps_seen += move**2
                steps = steps - 0.05 * move / np.sqrt(steps_seen)
        theta = np.append(steps[0], steps[0] + np.cumsum(np.exp(steps[1:])))
        yield pa.record_batch([pa.array([theta.astype("<f8").tobytes()]), pa.array([weights.astype("<f4").tobytes()])], names=["thresholds", "weights"])

    return run


def _rows(grades: list[int]):
    place = {g: k for k, g in enumerate(grades)}

    def run(batches):
        for batch in slices(batches):
            features, first = _features(batch.column("text"))
            blobs = [features[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([batch.column("id"), pa.array([place[g] for g in batch.column("label").to_pylist()], pa.int64()), pa.array(blobs, pa.binary())], names=["id", "level", "features"])

    return run


def fit_ordinal(docs: DataFrame, ratings: DataFrame, grade: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fits on at most `fit_rows` rated documents (those of the least id hashes), in one task of that bound.

    Features are made by the scanning tasks. Grades are any integers, MOST_GRADES different ones at most. With fewer than two grades
    there is nothing to part: the model then has no threshold.
    """
    grades = sorted(r[0] for r in ratings.select(F.col(grade).cast("long")).where(F.col(grade).isNotNull()).distinct().limit(MOST_GRADES + 1).collect())
    if len(grades) > MOST_GRADES:
        raise ValueError(f"{grade} has more than {MOST_GRADES} grades")
    none = OrdinalModel(grades, np.zeros(0), np.zeros(1 << BUCKET_BITS, np.float32))
    if len(grades) < 2:
        return none
    rows = labelled_sample(docs, ratings, grade, id_col, text_col, fit_rows).mapInArrow(_rows(grades), "id long, level long, features binary")
    found = rows.repartition(1).mapInArrow(_fit(len(grades)), "thresholds binary, weights binary").first()
    return OrdinalModel(grades, np.frombuffer(found["thresholds"], "<f8"), np.frombuffer(found["weights"], "<f4")) if found else none


def _grade(model: OrdinalModel, column: pa.Array, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens, expected grade, and probability of grade `level` or better, for each text."""
    features, first = _features(column)
    f = _scores(features, first, model.weights)
    if not len(model.thresholds):
        return np.diff(first), np.full(len(f), model.grades[0] if model.grades else np.nan), np.ones(len(f))
    above = _sigmoid(f[:, None] - model.thresholds[None, :])
    expected = model.grades[0] + above @ np.diff(model.grades)
    place = sum(g < level for g in model.grades)
    tail = np.ones(len(f)) if place == 0 else np.zeros(len(f)) if place > len(model.thresholds) else above[:, place - 1]
    return np.diff(first), expected, tail


def quality_scores(docs: DataFrame, model: OrdinalModel, level: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, expected_grade, tail_probability, accepted) of every whole text; accepted: P(grade >= level) >= least.

    One row for each input row, repeated rows included. A null or empty text has no tokens and gets the probabilities of f = 0. With
    fewer than two grades known every row is accepted (probability 1). Null ids pass through; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            n, expected, tail = _grade(model, batch.column("text"), level)
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(expected), pa.array(tail), pa.array(tail >= least)], names=["id", "n", "e", "t", "a"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, e double, t double, a boolean").toDF("doc_id", "n_tokens", "expected_grade", "tail_probability", "accepted")


def accepted_documents(docs: DataFrame, model: OrdinalModel, level: int = 1, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that `quality_scores` accepts; nothing is shuffled."""

    def run(batches):
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(_grade(model, batch.column(text_col), level)[2] >= least))

    return docs.mapInArrow(run, docs.schema)
