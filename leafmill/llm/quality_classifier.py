"""Quality classifier: naive Bayes support vectors (NBSVM).

Features are indicators of hashed 1-grams and 2-grams, over a text's words and over its words' shapes (case, length,
what they end with, whether a word repeats the one before): nothing but n-grams. Each is scaled by its class log-count ratio r = log((p + alpha) / |p + alpha|) - log((q + alpha) / |q + alpha|), or nothing if
fewer than LEAST_ROWS rows have it; a linear model with hinge loss is fitted to the scaled, length-normalised rows by dual coordinate descent; margins become probabilities by
Platt scaling on folds that the model of the fold hasn't seen.

The fit uses a sample of the labelled rows: at most MOST_ROWS of them, in at most twice PER_CLASS, and of these as many
as have MOST_FEATURES features together. Every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship_code
from .labelled import KEPT_WORDS, Words, few_rows, fold, platt, split_words, training_rows
from .shared import discard, written

MOST_ROWS, PER_CLASS = 6_000, 4_000
#: Features that the driver collects at most: 80 MB.
MOST_FEATURES = 20_000_000
BITS, ALPHA, COST, EPOCHS, FOLDS = 18, 1.0, 1.0, 12, 3
LEAST_ROWS = 3
ODD = np.uint64(0x9E3779B97F4A7C15)


class Shapes(Words):
    """A word's shape as a small number: case, length class, kind of the last character."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        case = 0 if word.islower() else 1 if word.isupper() and len(word) > 1 else 2 if word[:1].isupper() else 3
        last = word[-1:]
        end = 0 if last.isalpha() else 1 if last in ".,;:" else 2 if last.isdigit() else 3
        odd = sum(not c.isalnum() for c in word)
        value = self[word] = ((case * 4 + end) * 4 + min(len(word) // 4, 3)) * 4 + min(odd, 3)
        return value


def features(words: Words, shapes: Shapes, text: str, bits: int = BITS) -> np.ndarray:
    """The distinct buckets of a text's n-grams. A text without words has none."""
    found = split_words(text)
    if not found:
        return np.zeros(0, dtype=np.int64)
    one = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    shape = np.fromiter(map(shapes.__getitem__, found), dtype=np.uint64, count=len(found))
    same = one[1:] == one[:-1]
    parts = [
        one,
        one[:-1] * np.uint64(0x100000001B3) + one[1:],
        shape,
        shape[:-1] * np.uint64(512) + shape[1:] * np.uint64(2) + same,
    ]
    salted = [(x + np.uint64(kind << 56)) * ODD for kind, x in enumerate(parts)]
    both = np.concatenate([x ^ (x >> np.uint64(29)) for x in salted]) * ODD
    return np.unique(both >> np.uint64(64 - bits)).astype(np.int64)


def class_ratio(rows: list[np.ndarray], label: np.ndarray, size: int, alpha: float = ALPHA) -> np.ndarray:
    p, q = np.full(size, alpha), np.full(size, alpha)
    for x, y in zip(rows, label, strict=True):
        (p if y else q)[x] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where(p + q - 2 * alpha >= LEAST_ROWS, ratio, 0.0)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], label: np.ndarray, size: int, cost: np.ndarray, epochs: int, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear hinge-loss model: min |w|^2 / 2 + sum cost_i * hinge_i."""
    w, sign = np.zeros(size + 1), np.where(label == 1, 1.0, -1.0)
    dual = np.zeros(len(rows))
    norm = np.array([(v * v).sum() + 1.0 for v in values])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = sign[i] * (w[x] @ v + w[-1]) - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), cost[i])
            if step := new - dual[i]:
                w[x] += step * sign[i] * v
                w[-1] += step * sign[i]
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def one_class(label: np.ndarray) -> bool:
    return not len(label) or label.min() == label.max()


def fit(rows: list[np.ndarray], label: np.ndarray, size: int) -> np.ndarray:
    """Weights over buckets for a row's indicators divided by the root of their number; the last is the bias."""
    if one_class(label):  # nothing to tell apart
        return np.zeros(size + 1)
    ratio = class_ratio(rows, label, size)
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    share = label.mean()  # both classes weigh the same
    cost = COST * np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    w = dual_descent(rows, values, label, size, cost, EPOCHS)
    return np.append(w[:-1] * ratio, w[-1])


def margins(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return np.array([weights[x].sum() / np.sqrt(max(1, len(x))) + weights[-1] for x in rows])


def train(rows: list[np.ndarray], label: np.ndarray, size: int) -> tuple[np.ndarray, float, float]:
    """Weights, and the a and b that turn a margin into a probability."""
    if one_class(label):
        return np.zeros(size + 1), 0.0, 30.0 * (2 * float(label.mean() if len(label) else 0.5) - 1)
    part = np.arange(len(rows)) % FOLDS
    seen = np.zeros(len(rows))
    for k in range(FOLDS):
        inner = np.flatnonzero(part != k)
        w = fit([rows[i] for i in inner], label[inner], size)
        outer = np.flatnonzero(part == k)
        seen[outer] = margins(w, [rows[i] for i in outer])
    return fit(rows, label, size), *platt(seen, label)


def learn(docs: DataFrame, labels: DataFrame, allowed, text_col: str = "text") -> tuple[np.ndarray, float, float]:
    sample = training_rows(docs, labels, "quality", allowed, MOST_ROWS, PER_CLASS, text_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = Words(), Shapes()
        for batch in few_rows(batches):
            found = [features(words, shapes, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, type=pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["x", "label", "doc_id"]
            )

    ship_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = written(sample.mapInArrow(extract, f"x array<int>, label int, doc_id {kind}").withColumns({"n": F.size("x"), "order": F.xxhash64("doc_id")}), "features")
    # MOST_ROWS small rows
    sized = made.select("order", "doc_id", "n").orderBy("order", "doc_id").toArrow()
    fits = int(np.searchsorted(np.cumsum(sized.column("n").to_numpy()), MOST_FEATURES, side="right"))
    chosen = made if fits >= len(sized) else made.where(F.col("order") < sized.column("order")[fits].as_py())
    got = chosen.orderBy("order", "doc_id").select("x", "label").toArrow()
    discard(made)
    flat = got.column("x").combine_chunks()
    bounds, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    rows = [values[a:b].astype(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return train(rows, got.column("label").to_numpy(), 1 << BITS)


def score_documents(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (of quality 1), predicted.

    Learns from rows whose fold isn't `held_out`; only the text goes into a score. Null texts count as empty; a text
    without words scores what the bias gives. Null ids are not held out. No row, no result; without labels of both
    kinds every score is the same. Other columns of docs are not looked at.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    weights, a, b = learn(named, labels, fold("doc_id", folds) != held_out)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), a, b))  # 1 MB, whatever the data

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = Words(), Shapes()
        weights, a, b = model.value
        for batch in few_rows(batches):
            margin = margins(weights, [features(words, shapes, t) for t in batch.column(2).to_pylist()]).astype(float)
            score = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = named.schema["doc_id"].dataType.simpleString()
    out = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out")
    return named.select("doc_id", out, "text").mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, without the rows that score_documents() predicts 0; all columns as they are, and nothing is shuffled."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    weights, a, b = learn(named, labels, fold("doc_id", folds) != held_out)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), a, b))
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = Words(), Shapes()
        weights, a, b = model.value
        for batch in few_rows(batches):
            rows = [features(words, shapes, t or "") for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(a * margins(weights, rows).astype(float) + b >= 0, type=pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
