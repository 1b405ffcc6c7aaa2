"""Quality scores by positive-unlabelled learning (operator 6)."""

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

# Bytes fall into these classes; what is left is one more, and bytes above 127 another.
CLASSES = ("\n", "\t\r\x0b\x0c ", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "-_", "'\"", "|", "&", "*", "$", "%", "#", "<>", "(){}[]", "/\\", ":;", "=+@~^`")
N_CLASSES = len(CLASSES) + 2
N_FEATURES = N_CLASSES * N_CLASSES + 5

MOST_POSITIVE = 8_000
MOST_UNLABELLED = 16_000


@dataclass(frozen=True)
class Model:
    """A linear model on text features; ``prior`` is the share of positives it was told or estimated."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        logits = ((features - self.centre) / self.scale) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -30, 30)))


def _table() -> np.ndarray:
    table = np.full(256, len(CLASSES), dtype=np.uint16)
    table[128:] = len(CLASSES) + 1
    for number, characters in enumerate(CLASSES):
        table[np.frombuffer(characters.encode(), dtype=np.uint8)] = number
    return table


def features(texts: Iterable[str | None]) -> np.ndarray:
    """How texts are written (marks, capitals, lists, repetition), not what about or in which language.

    Square roots of the shares of pairs of neighbouring byte classes, how often
    words repeat the one before, the share of different words, the lengths of
    words and text. All 0 for an empty text.
    """
    table, rows = _table(), []
    for text in texts:
        row = np.zeros(N_FEATURES)
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if len(data):
            kinds = table[data]
            pairs = np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=N_CLASSES * N_CLASSES)
            spaces = int(np.count_nonzero(kinds <= 1))
            parts = text.split()
            again = sum(map(operator.eq, parts, parts[1:])) / max(len(parts), 1)
            row[:-5] = np.sqrt(pairs / max(len(data) - 1, 1))
            row[-5:] = (
                1.0,
                np.log1p(len(data) / (spaces + 1)),
                np.log1p(len(data)) / 10,
                min(4 * again, 1.0),
                len(set(parts)) / max(len(parts), 1),
            )
        rows.append(row)
    return np.array(rows).reshape(-1, N_FEATURES)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 500, rate: float = 0.05, decay: float = 1e-4
) -> Model:
    """Minimise the non-negative unbiased risk with logistic loss by gradient steps (Adam).

    Risk: prior * E+[loss(g)] + max(0, Eu[loss(-g)] - prior * E+[loss(-g)]).
    Where the second part turns negative, the step goes up it instead, which
    keeps the model from calling all trusted positives one class by heart.
    """
    centre, scale = unlabelled.mean(0), unlabelled.std(0)
    scale[scale < 1e-4] = 1.0
    p, u = ((rows - centre) / scale for rows in (positive, unlabelled))
    theta = np.zeros(p.shape[1] + 1, dtype=np.float32)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        as_positive = prior * _mean_gradient(p, sigmoid(zp) - 1.0)
        as_negative = _mean_gradient(u, sigmoid(zu)) - prior * _mean_gradient(p, sigmoid(zp))
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gradient = as_positive + as_negative if rest >= 0 else -as_negative
        gradient[:-1] += decay * theta[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(centre, scale, theta[:-1], float(theta[-1]), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 3, steps: int = 200, slip: float = 0.1) -> float:
    """The share of positives among the unlabelled, from positives and unlabelled alone.

    A model fitted on one half of both ranks the other half. Above any score
    the unlabelled hold at least the positives' share of that score times the
    prior, so the least ratio of the two shares bounds it; it is taken where the
    ratio with the samples' uncertainty (probability ``slip``) is least, which
    is where few negatives are left. The estimate is the prior of the next fit.
    """
    rng = np.random.default_rng(6)
    p, u = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    half_p, half_u = len(p) // 2, len(u) // 2
    if not half_p or not half_u:
        return 0.5
    slack = sum(np.sqrt(np.log(4 / slip) / 2 / n) for n in (len(p) - half_p, len(u) - half_u))
    prior = 0.5
    for _ in range(rounds):
        model = fit(p[:half_p], u[:half_u], prior, steps)
        of_p, of_u = (np.sort(model.score(rows).astype(np.float64)) for rows in (p[half_p:], u[half_u:]))
        above = lambda scores, at: 1 - np.searchsorted(scores, at) / len(scores)
        at = np.unique(of_p)
        share_p, share_u = above(of_p, at), above(of_u, at)
        best = np.argmin((share_u + slack) / share_p)
        prior = float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))
    return prior


def _mean_gradient(rows: np.ndarray, errors: np.ndarray) -> np.ndarray:
    return np.append(errors @ rows, errors.sum()) / len(rows)


def _sample(ids: DataFrame, most: int) -> DataFrame:
    """The ``most`` ids of smallest hash: the same rows in every run."""
    return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(most)


def _features_of(docs: DataFrame, ids: list[int]) -> np.ndarray:
    """Features of the chosen documents; only their numbers, one row per id and so no more than the sample's bound, reach the driver.

    Of rows that share an id the smallest numbers count.
    """
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                numbers = features(rows.column(1).to_pylist()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([x.tobytes() for x in numbers], pa.binary())], ["doc_id", "numbers"])

    measured = texts.mapInArrow(measure, "doc_id long, numbers binary")
    found = measured.groupBy("doc_id").agg(F.min("numbers").alias("numbers")).toPandas().sort_values("doc_id")
    return np.array([np.frombuffer(x, np.float32) for x in found["numbers"]], dtype=np.float32).reshape(-1, N_FEATURES)


def train(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    most_positive: int = MOST_POSITIVE,
    most_unlabelled: int = MOST_UNLABELLED,
) -> Model | None:
    """Learn from trusted positives and unlabelled documents, held-out ids apart.

    At most ``most_positive`` documents labelled 1 and ``most_unlabelled``
    documents of any kind are read for it, those of smallest hash. The class
    prior is estimated from these two samples (``estimated_prior``), unless
    given: documents labelled 0 teach nothing. A document labelled both ways
    counts as 0; null labels are none. Without a positive or without documents
    there is no model.
    """
    seen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    trusted = seen.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    positive = _features_of(docs, [row[0] for row in _sample(trusted, most_positive).collect()])
    if not len(positive):
        return None
    unlabelled = _features_of(docs, [row[0] for row in _sample(known, most_unlabelled).collect()])
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled) if prior is None else prior)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` and ``score`` of every whole text: 0 to 1, higher for likelier good.

    A null text scores as an empty one. Without a model every score is 0.5. A
    column ``score`` of the input is replaced.
    """
    if model is None:
        return docs.withColumn("score", F.lit(0.5))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            parts = [model.score(features(batch[at : at + 512])) for at in range(0, len(batch), 512)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return docs.withColumn("score", score(F.col("text").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs, load(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
