"""Toxicity by maximum-scoring segments.

A token's score is the log-odds of the texts that hold it being toxic, against all labelled texts. The counts have
Dirichlet priors in two levels: words that begin alike share a prior, and the prior of the beginnings is the share of
toxic texts. Words that don't stand out score a little below zero, so that the expected score is negative. A
linear-time scan finds every maximal scoring segment of a text. By Karlin-Altschul statistics the scores of such
segments in ordinary text follow an extreme-value law; lambda solves sum p * exp(lambda * s) = 1 over the scores of
ordinary text, K is fitted to the best segments of ordinary training texts. A segment is significant if it is expected
less than LEVEL times in a text of that length. A text's score is a logistic curve over the logarithm of the joint
expectation of its segments, fitted on training rows that the scores were not learned from.

The labelled sample is bounded (MOST_ROWS, PER_CLASS). Its texts stay on the executors, which count and scan them: the
driver gets the counts of at most MOST_TOKENS tokens that stand out, and some numbers for each text. Every row is
scored, over its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship_code
from .labelled import KEPT_WORDS, fold, platt, training_rows
from .shared import discard, written

MOST_ROWS, PER_CLASS = 8_000, 4_000
#: Prior weight in texts, least |z| of a word that stands out, score of other words, significance of a segment.
PRIOR, LEAST_Z, DRIFT, LEVEL = 4.0, 3.0, -0.3, 1e-2
#: Letters that make a beginning, folds for calibration, tokens that the driver learns scores of at most.
STEM, FOLDS, MOST_TOKENS = 5, 5, 200_000
#: Longer tokens are known by a digest, so that what is learned is small whatever the texts hold.
LONGEST = 64
_tokens = re.compile(r"\w+").findall


def split_tokens(text: str) -> list[str]:
    """The words of a text in small letters."""
    return [w if len(w) <= LONGEST else w[:STEM] + xxhash.xxh3_128_hexdigest(w.encode("utf-8", "surrogatepass")) for w in _tokens(text.lower())]


class Weights(dict):
    """Scores of tokens. One that no training text held scores as its beginning does."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__(words)
        self.words, self.stems = words, stems

    def __reduce__(self):
        return Weights, (self.words, self.stems)

    def __missing__(self, word: str) -> float:
        if len(self) > len(self.words) + KEPT_WORDS:
            self.clear()
            self.update(self.words)
        value = self[word] = self.stems.get(word[:STEM], DRIFT)
        return value

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.float64, count=len(tokens))


def _score(y1, y0, prior, base: float) -> tuple:
    """Log-odds under a Dirichlet prior, against the share of toxic texts, and its z; of numbers or columns."""
    log, root = (F.log, F.sqrt) if isinstance(y1, Column) else (np.log, np.sqrt)
    a, b = y1 + PRIOR * prior, y0 + PRIOR * (1 - prior)
    delta = log(a) - log(b) - float(np.log(base) - np.log(1 - base))
    return delta, delta / root(1 / a + 1 / b)


def log_odds(words: dict[str, tuple[int, int]], stems: dict[str, tuple[int, int]], base: float) -> Weights:
    """Scores of words and beginnings, by how many toxic and other texts hold them. Words that neither stand out nor
    begin like a beginning that does needn't be there."""
    stem_scores = {}
    for s, (y1, y0) in stems.items():
        delta, z = _score(y1, y0, base, base)
        if abs(z) >= LEAST_Z:
            stem_scores[s] = float(delta)
    word_scores = {}
    for w, (y1, y0) in words.items():
        if not y1 and not y0:
            continue
        stem = w[:STEM]
        s1, s0 = stems.get(stem, (0, 0))
        if abs(_score(y1, y0, base, base)[1]) >= LEAST_Z or (stem in stem_scores and not (y0 and y1)):
            word_scores[w] = float(_score(y1, y0, (s1 + PRIOR * base) / (s1 + s0 + PRIOR), base)[0])
        elif stem in stem_scores:
            word_scores[w] = DRIFT
    return Weights(word_scores, stem_scores)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time (Ruzzo and Tompa).

    Runs of tokens of one sign are joined first, since no maximal segment begins or ends inside one.
    """
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(up.astype(np.int8))) + 1
    starts = np.concatenate([[0], edge])
    ends = np.append(starts[1:], len(scores))
    sums = np.add.reduceat(scores, starts)
    found: list[list] = []  # start, end, total before, total after
    total = 0.0
    for begin, end, value in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if value <= 0:
            total += value
            continue
        item = [begin, end, total, total + value]
        total += value
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= item[3]:
                found.append([*item, j])
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:]
    return [(s, e, after - before) for s, e, before, after, _ in found]


def extreme_value(value: np.ndarray, count: np.ndarray, best: np.ndarray, length: np.ndarray) -> tuple[float, float]:
    """lambda and K. value, count: the scores of tokens of ordinary texts; best, length: their best segments and tokens."""
    p = count / max(count.sum(), 1)
    if len(value) < 2 or value.max() <= 0 or not len(best):
        return 1.0, 0.01
    low, high = 1e-3, 1.0
    while (p * np.exp(np.minimum(high * value, 500))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if (p * np.exp(np.minimum(mid * value, 500))).sum() > 1 else (mid, high)
    lam = (low + high) / 2
    # the chance that the best of n tokens stays below s is exp(-K n exp(-lambda s)): K by its maximum likelihood
    k = len(best) / max((length * np.exp(-lam * best)).sum(), 1e-9)
    return lam, float(np.clip(k, 1e-6, 1.0))


def evidence(found: list[tuple[int, int, float]], n: int, lam: float, k: float) -> tuple[float, list[tuple[int, int, float]]]:
    """-log of the joint expectation of a text's significant segments (of its best if none is), and those segments."""
    if not found:
        return -np.log1p(k * max(n, 1)), []
    gain = [lam * s - np.log(k * max(n, 1)) for _, _, s in found]
    strong = [(s, e, g) for (s, e, _), g in zip(found, gain, strict=True) if g >= -np.log(LEVEL)]
    return (float(sum(g for _, _, g in strong)), strong) if strong else (max(gain), [])


class Model:
    def __init__(self, weights: Weights, lam: float, k: float, a: float, b: float):
        self.weights, self.lam, self.k, self.a, self.b = weights, lam, k, a, b

    def of(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        x = self.weights.of(split_tokens(text))
        total, strong = evidence(segments(x), len(x), self.lam, self.k)
        return float(1 / (1 + np.exp(-np.clip(self.a * np.clip(total, *RANGE) + self.b, -35, 35)))), strong


#: Evidence beyond these doesn't count further.
RANGE = (-10.0, 20.0)


def _token_counts(sample: DataFrame) -> DataFrame:
    """token, is_stem, n: how many texts of each part and label hold it, at 2 * part + label."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, label, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = set(split_tokens(text))
                seen.update((w, False, 2 * part + label) for w in held)
                seen.update((w, True, 2 * part + label) for w in {w[:STEM] for w in held})
            rows = [(*k, n) for k, n in seen.items()]
            kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=["token", "is_stem", "at", "n"])

    each = sample.select("text", "label", "part").mapInArrow(work, "token string, is_stem boolean, at int, n long")
    sums = F.array(*[F.sum(F.when(F.col("at") == i, F.col("n")).otherwise(0)) for i in range(2 * FOLDS)])
    return each.groupBy("token", "is_stem").agg(sums.alias("n"))


def _of_model(n, label: int, model: int):
    """Texts of a label in a model's parts: all but its own; model FOLDS has all."""
    return sum((n[2 * p + label] for p in range(FOLDS) if p != model), start=0 * n[0])


def learn_weights(sample: DataFrame) -> list[Weights]:
    """Scores of each model: model k has all parts of the sample but part k, the last has all."""
    texts = [0] * (2 * FOLDS)
    for r in sample.groupBy("part", "label").count().collect():
        texts[2 * r.part + r.label] = r["count"]
    base = []
    for m in range(FOLDS + 1):
        y1, y0 = _of_model(texts, 1, m), _of_model(texts, 0, m)
        base.append(float(np.clip(y1 / max(y1 + y0, 1), 1e-6, 1 - 1e-6)))
    counts = written(_token_counts(sample), "token-counts")
    # a token is wanted if it stands out in any model, or its beginning does
    z = F.greatest(*[F.abs(_score(_of_model(F.col("n"), 1, m), _of_model(F.col("n"), 0, m), base[m], base[m])[1]) for m in range(FOLDS + 1)])
    scored = counts.withColumn("z", z)
    strong = F.col("z") >= LEAST_Z
    stems = scored.where("is_stem").select(F.col("token").alias("stem"), F.col("n").alias("stem_n"), strong.alias("stem_strong"))
    words = scored.where("not is_stem").join(stems, F.substring("token", 1, STEM) == F.col("stem")).where(strong | F.col("stem_strong"))
    top = words.orderBy(F.desc("z"), "token").limit(MOST_TOKENS).select("token", "n", "stem", "stem_n").collect()
    alone = scored.where(F.col("is_stem") & strong).orderBy(F.desc("z"), "token").limit(MOST_TOKENS).select("token", "n").collect()
    discard(counts)
    stem_n = {r.stem: r.stem_n for r in top} | {r.token: r.n for r in alone}
    pair = lambda n, m: (_of_model(n, 1, m), _of_model(n, 0, m))
    return [log_odds({r.token: pair(r.n, m) for r in top}, {s: pair(n, m) for s, n in stem_n.items()}, base[m]) for m in range(FOLDS + 1)]


def _background(sample: DataFrame, weights: list[Weights]) -> list[tuple[float, float]]:
    """lambda and K of each model, from the ordinary texts of its parts."""
    known = sample.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            best = []
            for text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tokens := split_tokens(text):
                    for m in (m for m in range(FOLDS + 1) if m != part):
                        x = known.value[m].of(tokens)
                        for v, n in zip(*(a.tolist() for a in np.unique(x, return_counts=True)), strict=True):
                            seen[m, v] += n
                        best.append((m, max((s for *_, s in segments(x)), default=0.0), len(x), True))
            rows = [(m, v, n, False) for (m, v), n in seen.items()] + best
            kinds = [pa.int32(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=["model", "value", "n", "is_best"])

    found = written(sample.where("label = 0").select("text", "part").mapInArrow(work, "model int, value double, n long, is_best boolean"), "background")
    # at most as many scores as the models have tokens, and a row for each text and model
    scores = found.where("not is_best").groupBy("model", "value").agg(F.sum("n").alias("n")).orderBy("model", "value").toArrow()
    best = found.where("is_best").orderBy("model", "value", "n").toArrow()
    discard(found)
    out = []
    for m in range(FOLDS + 1):
        s, b = (t.filter(pc.equal(t.column("model"), m)) for t in (scores, best))
        out.append(extreme_value(*(t.column(c).to_numpy() for t in (s, b) for c in ("value", "n"))))
    return out


def _evidence(sample: DataFrame, weights: list[Weights], background: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Each training text's evidence, by the model that hasn't seen its part, and its label."""
    known = sample.sparkSession.sparkContext.broadcast((weights, background))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, background = known.value
        for batch in batches:
            total = []
            for text, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = weights[part].of(split_tokens(text))
                total.append(float(evidence(segments(x), len(x), *background[part])[0]))
            yield pa.RecordBatch.from_arrays([pa.array(total, type=pa.float64()), batch.column(1)], names=["total", "label"])

    got = sample.select("text", "label", "part").mapInArrow(work, "total double, label int").orderBy("total", "label").toArrow()
    return got.column("total").to_numpy(), got.column("label").to_numpy()


def learn(docs: DataFrame, labels: DataFrame, allowed) -> Model:
    """docs: doc_id, text without nulls. Each part of the sample calibrates the scores that the other parts give."""
    sample = training_rows(docs, labels, "toxic", allowed, MOST_ROWS, PER_CLASS)
    sample = written(sample.select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(FOLDS)).cast("int").alias("part")), "sample")
    kinds = [r.label for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        model = Model(Weights({}, {}), 1.0, 0.01, 0.0, 30.0 if kinds == [1] else -30.0)
    else:
        weights = learn_weights(sample)
        background = _background(sample, weights)
        total, label = _evidence(sample, weights, background)
        model = Model(weights[FOLDS], *background[FOLDS], *platt(np.clip(total, *RANGE), label))
    discard(sample)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (of toxic 1), predicted, passages.

    passages: start, end (tokens) and strength of every significant passage. Learns from rows whose fold isn't
    `held_out`; only the text goes into a score. Null texts count as empty and have no passages. Null ids are not held
    out. No row, no result; without labels of both kinds every score is the same. Other columns are not looked at.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ship_code(docs.sparkSession)
    # the scores of words in the bounded sample: a few MB, whatever the data
    model = docs.sparkSession.sparkContext.broadcast(learn(named, labels, fold("doc_id", folds) != held_out))
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("strength", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            scored = [known.of(t) for t in batch.column(2).to_pylist()]
            score = np.array([s for s, _ in scored])
            spans = pa.array([[{"start": a, "end": b, "strength": g} for a, b, g in x] for _, x in scored], type=passage)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), spans],
                names=["doc_id", "held_out", "score", "predicted", "passages"],
            )

    kind = named.schema["doc_id"].dataType.simpleString()
    out = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out")
    return named.select("doc_id", out, "text").mapInArrow(
        work, f"doc_id {kind}, held_out boolean, score double, predicted int, passages array<struct<start:int,end:int,strength:double>>"
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("passages")
