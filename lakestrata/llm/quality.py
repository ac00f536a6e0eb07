"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text gives a vector of statistics. Scaled by the mean and deviation of the training rows, it is mapped to
`features` random cosines, whose inner products approximate a Gaussian kernel. Ridge weights solve the normal
equations; every task sums its own part of them, and the parts are added in a tree, so what reaches the driver
is one matrix. An isotonic curve, fitted on training rows that the ridge has not seen, turns
the regression into a probability; in between its steps it is interpolated, so scores keep their order.

The fit reads at most `most_labelled` labelled rows, those of the smallest hash, a stated bound; remainder 0 of the
ids' crc32 goes to the ridge, 2 to the curve, and 1 is never read.

Defined results: null and empty texts have statistics of zeros and are scored like others. Null labels are left out; with
several labels for an id the largest counts. With no training rows, or one class only, every score is the
share of good rows (0.5 without any). Repeated rows get equal scores. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.common import fold, whole_text
from lakestrata.llm.toxicity import MOST_LABELLED, labelled_rows
from lakestrata.llm.words import buffers, chunks, words_of

FEATURES = 256
RIDGE = 1e-3
SEED = 20250505
LEAST_DEVIATION = 1e-6

KINDS = {
    "upper": range(ord("A"), ord("Z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "space": [32],
    "line": [10],
    "stop": [ord(c) for c in ".,;:?'\"()-"],
    "loud": [ord("!")],
    "sign": [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"],
    "beyond": range(128, 256),
}
STATISTICS = len(KINDS) + 8


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    raw, begins = buffers(texts)
    rows = len(texts)
    sizes = np.diff(begins)
    per = np.maximum(sizes, 1)
    out = np.zeros((rows, STATISTICS))
    for k, values in enumerate(KINDS.values()):
        wanted = np.zeros(256, bool)
        wanted[list(values)] = True
        sums = np.concatenate([[0], np.cumsum(wanted[raw])])
        out[:, k] = np.sqrt((sums[begins[1:]] - sums[begins[:-1]]) / per)
    words = words_of(texts)
    counts, owner, h = words.counts, words.owner, words.hashes
    per_words = np.maximum(counts, 1)
    k = len(KINDS)
    out[:, k] = np.log1p(sizes)
    out[:, k + 1] = np.log1p(counts)
    lengths = words.ends - words.starts
    out[:, k + 2] = np.bincount(owner, lengths, rows) / per_words
    out[:, k + 3] = np.sqrt(np.bincount(owner, lengths.astype(float) ** 2, rows) / per_words)
    if len(h):
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        out[:, k + 4] = np.sqrt(np.bincount(owner, same, rows) / per_words)
        order = np.lexsort((h, owner))
        o, v = owner[order], h[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        out[:, k + 5] = np.bincount(o[new], minlength=rows) / np.sqrt(per_words) / np.sqrt(np.maximum(per_words, 1))
        runs = np.diff(np.append(np.flatnonzero(new), len(v)))
        most = np.zeros(rows)
        np.maximum.at(most, o[new], runs)
        out[:, k + 6] = np.sqrt(most / per_words)
    out[:, k + 7] = np.log1p(sizes / np.maximum(out[:, 3] ** 2 * per, 1))
    return out


def cosines(scaled: np.ndarray, features: int) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel over scaled statistics, and a constant."""
    random = np.random.default_rng(SEED)
    directions = random.normal(size=(STATISTICS, features)) / np.sqrt(STATISTICS)
    shifts = random.uniform(0, 2 * np.pi, features)
    waves = np.cos(scaled @ directions + shifts) * np.sqrt(2 / features)
    return np.hstack([waves, np.ones((len(scaled), 1))])


def summed(rows: DataFrame, part) -> np.ndarray | None:
    """The sum of an array that `part(batch)` gives, added up within tasks and then in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                own = part(np.asarray(batch.column(0).slice(at, len(texts)), dtype=float), texts)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary())], ["sums"])

    sums = rows.select("label", "text").mapInArrow(run, "sums binary").rdd.map(lambda row: np.frombuffer(row[0]))
    if sums.isEmpty():
        return None
    return sums.treeReduce(lambda a, b: a + b)


def isotonic(values: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve of least squares: centres of its steps and their heights."""
    order = np.argsort(values, kind="stable")
    blocks: list[list[float]] = []  # sum of good, rows, sum of values
    for x, y in zip(values[order], good[order]):
        blocks.append([y, 1.0, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks)
    return table[:, 2] / table[:, 1], table[:, 0] / table[:, 1]


class Model:
    """Scores texts once fitted; without enough labels it gives a constant."""

    def __init__(self, share: float, features: int):
        self.share, self.features = share, features
        self.weights: np.ndarray | None = None

    def raw(self, texts: pa.Array) -> np.ndarray:
        return cosines((statistics(texts) - self.mean) / self.deviation, self.features) @ self.weights

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        raw = self.raw(texts)
        curve = np.interp(raw, self.knots, self.heights)
        # beyond and between the steps a small share of the regression keeps the order
        # (rounded, as matrix products differ in the last bits with the size of a batch)
        return np.round(np.clip(0.98 * curve + 0.02 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0), 9)


def fit(rows: DataFrame, features: int, ridge: float) -> Model:
    """Fit on labelled rows (doc_id, label, text)."""
    spark = rows.sparkSession
    share, count = rows.agg(F.avg("label"), F.count(F.lit(1))).first()
    model = Model(0.5 if share is None else float(share), features)
    first, second = rows.filter(fold() == 0), rows.filter(fold() == 2)

    def moments(labels: np.ndarray, texts: pa.Array) -> np.ndarray:
        x = statistics(texts)
        return np.concatenate([[len(x), labels.sum()], x.sum(0), (x * x).sum(0)])

    sums = summed(first, moments)
    if sums is None or not 0 < sums[1] < sums[0] or not 0 < model.share < 1:
        return model
    model.mean = sums[2 : 2 + STATISTICS] / sums[0]
    spread = sums[2 + STATISTICS :] / sums[0] - model.mean**2
    model.deviation = np.where(spread > LEAST_DEVIATION, np.sqrt(np.maximum(spread, LEAST_DEVIATION)), 1.0)
    mean, deviation, good = model.mean, model.deviation, sums[1] / sums[0]
    size = features + 1

    def equations(labels: np.ndarray, texts: pa.Array) -> np.ndarray:
        x = cosines((statistics(texts) - mean) / deviation, features)
        weight = np.where(labels == 1, 0.5 / good, 0.5 / (1 - good))[:, None]  # both classes weigh the same
        return np.concatenate([(x.T @ (x * weight)).ravel(), (x.T @ (labels[:, None] * weight)).ravel()])

    sums = summed(first, equations)
    model.weights = np.linalg.solve(sums[: size * size].reshape(size, size) + ridge * np.eye(size), sums[size * size :])
    shared = spark.sparkContext.broadcast(model)

    def regress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(shared.value.raw(texts))], ["label", "raw"]
                )

    # two numbers for each of at most `most_labelled` rows
    curve = second.select("label", "text").mapInArrow(regress, "label int, raw double").toPandas()
    if curve["label"].nunique() < 2:
        model.weights = None
        return model
    model.knots, model.heights = isotonic(curve["raw"].to_numpy(), curve["label"].to_numpy(float))
    return model


def quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    features: int = FEATURES,
    ridge: float = RIDGE,
    most_labelled: int = MOST_LABELLED,
    id_column: str = "doc_id",
    text_column: str = "text",
    score: str = "score",
) -> DataFrame:
    """`docs` with a column of scores from 0 to 1; labels of held-out ids are not read."""
    model = fit(labelled_rows(docs, labels, label, most_labelled, id_column, text_column), features, ridge)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = "text_to_score"
    while whole in docs.columns:
        whole = f"_{whole}"
    schema = docs.select("*", F.lit(0.0).alias(score)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(batch.num_columns - 1)):
                kept = [batch.column(k).slice(at, len(texts)) for k in range(batch.num_columns - 1)]
                found = pa.array(shared.value.score(texts))
                yield pa.RecordBatch.from_arrays([*kept, found], [f.name for f in schema.fields])

    return docs.withColumn(whole, whole_text(text_column)).mapInArrow(run, schema)
