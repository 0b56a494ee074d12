"""Labelled rows to learn from, and words as numbers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty


def fold(id_col: str, folds: int):
    """The fold of a row: crc32 of its id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed, most: int, per_class: int, text_col: str = "text") -> DataFrame:
    """text, label (0, 1, int) and doc_id of a bounded sample of the labelled rows, of those for which `allowed` holds.

    The sample is the rows of smallest hashed id, at most `per_class` of the rarer kind and `most` together; both
    bound what is broadcast and what the driver collects, whatever the data. Rows without a label don't count; of
    several labels for an id the largest does.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & allowed)
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ones = known.where("label = 1").orderBy(*order).limit(per_class)
    zeros = known.where("label = 0").orderBy(*order).limit(per_class)
    either = ones.unionByName(zeros).orderBy(*order).limit(most)
    wanted = F.broadcast(either.withColumnRenamed("doc_id", "__labelled"))
    return docs.join(wanted, F.col("doc_id") == F.col("__labelled")).select(text_or_empty(text_col).alias("text"), "label", "doc_id")


#: Words that a worker keeps the numbers of: some 25 MB.
KEPT_WORDS = 150_000


class Words(dict):
    """Word to a 32-bit number, kept for words that were seen; forgets when it gets large, which only costs time."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


#: ASCII white space; str.split() would also cut at other spaces.
split_words = re.compile(r"[^\x20\x09-\x0D]+").findall


#: Rows that a worker has the features of at a time.
ROWS_AT_ONCE = 256


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what is made of a batch's texts can be several times as large as they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """a, b of sigmoid(a * margin + b), by Newton steps on smoothed labels."""
    n1 = label.sum()
    goal = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (len(label) - n1 + 2))
    scale = max(float(np.std(margin)), 1e-9)
    x, a, b = margin / scale, 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - goal) * x).sum() + 1e-3 * a, (p - goal).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        length = min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - length * step[0], b - length * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b
