"""Mixing sources to target weights by fixed-length blocks.

Each source's words, document after document, are packed into blocks of `block` words. The driver draws, for each
output shard in turn, how many of its slots each source gets: a multinomial draw with what each source still has to
reach its target as weights, so that the totals close in on the targets. Slot k of a source takes block P(k mod n) of
pass k div n, where P is a pseudorandom permutation of the n block indexes, another one for each source and pass. Slots
and blocks then meet in a join on (source, block index). No source is passed over more than twice.

A source's documents follow each other in an order that their ids and texts give (see running_totals()), so the mix is
the same under any settings and file layout. Documents equal in both are interchangeable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship_code
from .shared import running_totals, shuffle_partitions, text_or_empty, word_count, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BLOCK, SHARDS, SEED = 64, 64, 20240611
#: Sources at most: the driver draws for each one, and holds SHARDS numbers of it (10 MB). More are refused.
MOST_SOURCES = 20_000
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take from each source: share * sum(sizes) by weight, none above most * its size.

    What a source can't take is shared out among the others by weight, again until none is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = share * sum(sizes) - sum(most * sizes[i] for i in full)
        open_weight = sum(w for i, w in enumerate(weight) if i not in full)
        goal = [most * s if i in full else rest * weight[i] / open_weight for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and goal[i] > most * s}
        if not over:
            return goal
        full |= over


def draw_slots(goals: list[float], sizes: list[int], block: int, shards: int, most: int = 2, seed: int = SEED) -> np.ndarray:
    """Slots of each source in each output shard, (shards, sources); at most `most` times its blocks for any source."""
    size = np.array(sizes, dtype=np.float64)
    blocks = np.ceil(size / block).astype(np.int64)
    per_block = np.where(blocks > 0, size / np.maximum(blocks, 1), 1.0)
    quota = np.minimum(np.rint(np.array(goals) / per_block).astype(np.int64), most * blocks)
    rng = np.random.Generator(np.random.PCG64(seed))
    drawn = np.zeros(len(sizes), dtype=np.int64)
    table = np.zeros((shards, len(sizes)), dtype=np.int64)
    for shard in range(shards):
        left = int(quota.sum() - drawn.sum())
        todo = left // (shards - shard)
        while todo > 0:
            weight = np.maximum(quota - drawn, 0)
            room = most * blocks - drawn
            weight = np.where(room > 0, weight, 0)
            if not weight.any():
                break
            if shard == shards - 1:  # the last shard levels out what the draws left
                got = np.minimum(weight * todo // max(todo, int(weight.sum())), room)
            if shard < shards - 1 or not got.any():
                got = np.minimum(rng.multinomial(todo, weight / weight.sum()), room)
            table[shard] += got
            drawn += got
            todo -= int(got.sum())
    return table


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of range(n) at these indexes: a Feistel network on the next even number of bits,
    walked on until the value is below n."""
    if n <= 1:
        return np.zeros(len(index), dtype=np.int64)
    half = np.uint64((max(2, int(n - 1).bit_length()) + 1) // 2)
    low = np.uint64((1 << int(half)) - 1)
    keys = _mixed(np.array([key * 16 + r + 1 for r in range(rounds)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & low
        for k in keys:
            left, right = right, left ^ (_mixed(right + k) & low)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def slots(spark: SparkSession, table: np.ndarray, sizes: list[int], block: int, seed: int = SEED) -> DataFrame:
    """Every slot of the mix: shard, slot (in the shard), source_no, block, pass. table: what draw_slots() gives."""
    per_source = table.sum(axis=0)
    first = np.concatenate([[0], np.cumsum(per_source)])  # slots are numbered source after source
    in_source = np.cumsum(table, axis=0)  # (shards, sources): slots of the source up to and with this shard
    in_shard = np.cumsum(table, axis=1) - table  # (shards, sources): slots of the shard before this source
    blocks = [-(-s // block) for s in sizes]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                source = np.searchsorted(first, ids, side="right") - 1
                out = {k: np.zeros(len(ids), dtype=np.int64) for k in ("shard", "slot", "block", "pass")}
                for s in np.unique(source):
                    here = np.flatnonzero(source == s)
                    k = ids[here] - first[s]
                    shard = np.searchsorted(in_source[:, s], k, side="right")
                    before = in_source[shard, s] - table[shard, s]
                    out["shard"][here] = shard
                    out["slot"][here] = in_shard[shard, s] + k - before
                    turn = k // blocks[s]
                    out["pass"][here] = turn
                    for p in np.unique(turn):
                        own = turn == p
                        out["block"][here[own]] = permuted(k[own] - p * blocks[s], blocks[s], seed + 2 * int(s) + int(p))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["shard"].astype(np.int32)), pa.array(out["slot"]), pa.array(source.astype(np.int32)),
                     pa.array(out["block"]), pa.array(out["pass"].astype(np.int32))],
                    names=["shard", "slot", "source_no", "block", "pass"],
                )

    parts = max(1, min(4096, int(first[-1]) // 200_000 + 1))
    parts = max(parts, min(shuffle_partitions(spark), int(first[-1]) // 20_000 + 1))
    ship_code(spark)
    return spark.range(0, int(first[-1]), 1, parts).mapInArrow(number, "shard int, slot long, source_no int, block long, pass int")


class Mix:
    """A mix of docs: `rows` (row_no, doc_id, digest, source, size, source_no, source_size, target, first word in its
    source), `slots`, and `pieces` (which words of which row a block holds)."""

    def __init__(self, rows: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED):
        """rows: a written table of row_no (unique), doc_id, digest, source, size. ValueError beyond MOST_SOURCES."""
        spark = rows.sparkSession
        found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"a mix takes {MOST_SOURCES} sources at most")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        self.sizes = [r["size"] for r in found]
        self.goals = targets(self.sizes) if found else []
        self.block = block
        known = spark.createDataFrame(
            [(r.source, i, r["size"], float(g)) for i, (r, g) in enumerate(zip(found, self.goals, strict=True))],
            "name string, source_no int, source_size long, target double",
        )
        numbered = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        self.rows = running_totals(numbered, "source_no", ["doc_id", "digest"], "size", "first_word")
        table = draw_slots(self.goals, self.sizes, block, shards, seed=seed) if found else np.zeros((shards, 0), dtype=np.int64)
        self.slots = slots(spark, table, self.sizes, block, seed)
        end = F.col("first_word") + F.col("size")
        inside = self.rows.where("size > 0").select(
            "row_no", "source_no", "first_word", end.alias("end"),
            F.explode(F.sequence(F.floor(F.col("first_word") / block), F.floor((end - 1) / block))).alias("block"),
        )
        from_word = F.greatest("first_word", F.col("block") * block)
        to_word = F.least("end", (F.col("block") + 1) * block)
        self.pieces = inside.select(
            "row_no", "source_no", "block", (from_word - F.col("first_word")).alias("from_word"), (to_word - from_word).alias("words")
        )

    def taken_pieces(self) -> DataFrame:
        """Slots joined with blocks by index: row_no, from_word, words, times."""
        times = self.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
        return self.pieces.join(times, ["source_no", "block"])


def _rows(docs: DataFrame, row_no: Column, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        row_no.alias("row_no"), F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), F.col(source_col).alias("source"), word_count(text).alias("size"),
    )


def mix_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken.

    Null texts and texts without words have size 0 and give nothing; null is a source of its own, the last. Repeated
    rows are rows of their own, null ids are like others. No row, no result. Other columns of docs are not looked at.
    """
    mix = Mix(written(_rows(docs, F.monotonically_increasing_id(), id_col, text_col, source_col), "mix-rows"), **options)
    taken = mix.taken_pieces().groupBy("row_no").agg(F.sum(F.col("words") * F.col("times")).alias("got"))
    return mix.rows.join(taken, "row_no", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: docs' columns, where a text is what one pass takes of it.

    A text that a pass takes whole stays as it is; of another, the words of the blocks that were taken stand in order,
    one space between. So a row comes out at most twice, and not at all if no block of it was drawn. Texts without
    words pass through once: they have nothing to weigh. Null texts stay null, null is a source of its own, the last;
    repeated rows are rows of their own. No row, no result. All columns stay; `n_chars` counts the new text, if it was
    not null.
    """
    columns = docs.columns
    kept = written(docs.withColumn("__row_no", F.monotonically_increasing_id()), "mix-docs")
    mix = Mix(written(_rows(kept, F.col("__row_no"), id_col, text_col, source_col), "mix-rows"), **options)
    spans = (
        mix.taken_pieces()
        .groupBy("row_no")
        .agg(F.array_sort(F.collect_list(F.struct("from_word", "words", "times"))).alias("__spans"))
        .withColumnRenamed("row_no", "__span_row")
    )
    sized = mix.rows.select(F.col("row_no").alias("__no"), F.col("size").alias("__size"))
    joined = (
        kept.join(sized, F.col("__row_no") == F.col("__no"))
        .join(spans, F.col("__row_no") == F.col("__span_row"), "left")
        .where((F.col("__size") == 0) | F.col("__spans").isNotNull())
    )
    passes = F.when(F.col("__size") == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.array_max("__spans.times").cast("int")))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"))
    in_pass = F.filter("__spans", lambda s: s["times"] >= F.col("__pass"))
    whole = F.aggregate(in_pass, F.lit(0).cast("long"), lambda n, s: n + s["words"]) == F.col("__size")
    cut = F.array_join(
        F.flatten(F.transform(in_pass, lambda s: F.slice(words, (s["from_word"] + 1).cast("int"), s["words"].cast("int")))), " "
    )
    mixed = joined.withColumn("__pass", F.explode(passes)).withColumn(
        text_col, F.when((F.col("__size") == 0) | whole, F.col(text_col)).otherwise(cut)
    )
    if "n_chars" in columns:
        mixed = mixed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length(text_col).cast("long")))
    return mixed.select(*columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
