"""Sharding by minimax contiguous partition.

Equal texts form an atomic group. Groups are ordered by a 60-bit prefix of their text's SHA-256, and shards are
contiguous ranges in that order. The smallest feasible shard capacity is found by binary search; a capacity is
checked greedily, filling shard after shard. The driver never sees all groups: it holds totals of key ranges and, where
a cut could fall, splits ranges into 64 finer ones, until the capacity that is feasible with ranges as they are equals
the lower bound that lets ranges be cut anywhere. That proves the optimum over the single groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions, text_or_empty, written

KEY_BITS, FIRST_BITS, SPLIT_BITS = 60, 14, 6


class Ranges:
    """Key ranges in order: total bytes, number of groups and largest group of each."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        """rows: (bits, prefix, bytes, groups, largest); a range holds the keys that begin with these bits."""
        self.rows = sorted(rows, key=lambda r: r[1] << (KEY_BITS - r[0]))
        self.start_key = [r[1] << (KEY_BITS - r[0]) for r in self.rows]
        self.bytes = np.array([r[2] for r in self.rows], dtype=np.int64)
        self.single = np.array([r[3] == 1 for r in self.rows], dtype=bool)
        self.largest = np.array([r[4] for r in self.rows], dtype=np.int64)
        self.ends = np.cumsum(self.bytes)
        self.starts = self.ends - self.bytes
        self.total = int(self.ends[-1]) if len(rows) else 0

    def next_whole(self, at: int, capacity: int) -> int:
        """The offset that a shard reaches from offset `at` if ranges can't be cut."""
        k = int(np.searchsorted(self.ends, at + capacity, side="right"))
        return int(self.ends[k - 1]) if k else 0

    def next_cut(self, at: int, capacity: int) -> int:
        """The same if ranges of several groups can be cut anywhere."""
        to = at + capacity
        if to >= self.total:
            return self.total
        k = int(np.searchsorted(self.ends, to, side="right"))
        return int(self.starts[k]) if self.single[k] else to

    def feasible(self, capacity: int, shards: int, step) -> bool:
        at = 0
        for _ in range(shards):
            to = step(at, capacity)
            if to <= at:
                return False
            at = to
            if at >= self.total:
                return True
        return False

    def least(self, shards: int, step, low: int) -> int:
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.feasible(mid, shards, step):
                high = mid
            else:
                low = mid + 1
        return low

    def bounds(self, shards: int) -> tuple[int, int]:
        low = max(int(self.largest.max()), -(-self.total // shards))
        low = self.least(shards, self.next_cut, low)
        return low, self.least(shards, self.next_whole, low)

    def doubtful(self, shards: int, low: int, high: int) -> list[int]:
        """Ranges of several groups in which some greedy cut can fall for a capacity between low and high."""
        found: set[int] = set()
        early = late = 0
        for _ in range(shards):
            k = min(int(np.searchsorted(self.ends, early + low, side="right")), len(self.rows) - 1)
            early = int(self.starts[k])
            late = min(late + high, self.total)
            last = min(int(np.searchsorted(self.ends, late, side="right")), len(self.rows) - 1)
            found.update(i for i in range(k, last + 1) if not self.single[i])
            if early >= self.total:
                break
        return sorted(found)

    def cuts(self, shards: int, capacity: int) -> list[int]:
        """First keys of shards 1, 2, ...: within the capacity, and as even as ranges allow."""
        mean, large = self.total / shards, 0
        while True:  # groups above the mean fill a shard each; the others share the rest
            over = self.largest[self.largest > mean]
            if len(over) == large or len(over) >= shards:
                break
            large = len(over)
            mean = (self.total - int(over.sum())) / (shards - large)
        need = [self.total]  # need[j]: where the last j shards must begin at the earliest
        for _ in range(shards - 1):
            k = int(np.searchsorted(self.starts, need[-1] - capacity, side="left"))
            need.append(int(self.starts[k]) if k < len(self.rows) else self.total)
        need += [0]
        at, found = 0, []
        for shard in range(shards - 1):
            furthest = self.next_whole(at, capacity)
            earliest = max(need[shards - 1 - shard], at)
            k = int(np.searchsorted(self.ends, at + mean))
            around = [int(self.ends[i]) for i in (k - 1, k) if 0 <= i < len(self.rows)] + [earliest, furthest]
            to = min((x for x in around if earliest <= x <= furthest), key=lambda x: (abs(x - at - mean), x))
            at = max(to, at)
            k = int(np.searchsorted(self.starts, at, side="left"))
            found.append(self.start_key[k] if k < len(self.rows) else 1 << KEY_BITS)
        return found


def _totals(groups: DataFrame, bits: int, of: DataFrame | None = None, of_bits: int = 0) -> list[tuple[int, int, int, int, int]]:
    prefix = F.shiftright("key", KEY_BITS - bits)
    if of is not None:
        groups = groups.join(F.broadcast(of), F.shiftright("key", KEY_BITS - of_bits) == F.col("parent"), "left_semi")
    found = groups.groupBy(prefix.alias("prefix")).agg(
        F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("m")
    )
    return [(bits, r.prefix, r.b, r.n, r.m) for r in found.collect()]


def plan_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """groups: key, bytes. The least capacity of contiguous shards, and the first key of every shard but the first."""
    spark = groups.sparkSession
    ranges = Ranges(_totals(groups, FIRST_BITS))
    if not ranges.rows:
        return 0, [1 << KEY_BITS] * (shards - 1)
    while True:
        low, high = ranges.bounds(shards)
        split = [i for i in ranges.doubtful(shards, low, high) if ranges.rows[i][0] < KEY_BITS] if low < high else []
        if not split:
            return high, ranges.cuts(shards, high)
        rows = [r for i, r in enumerate(ranges.rows) if i not in set(split)]
        for bits in sorted({ranges.rows[i][0] for i in split}):
            finer = min(bits + SPLIT_BITS, KEY_BITS)
            # at most some thousands of ranges, by the number of shards: not by the data
            parents = spark.createDataFrame([(ranges.rows[i][1],) for i in split if ranges.rows[i][0] == bits], "parent long")
            rows += _totals(groups, finer, parents, bits)
        ranges = Ranges(rows)


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: the largest shard is as small as contiguous shards of whole groups of equal texts can be. Null texts
    count as empty and cost 16 bytes; repeated rows and null ids each get a slot of their own. No row, no result.
    Other columns of docs are not looked at. Slots are gapless from 0 in each shard.
    """
    text = text_or_empty(text_col)
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row_no"),
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.conv(F.substring(F.sha2(text, 256), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        ),
        "sizes",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    _, cuts = plan_cuts(groups, shards)
    firsts = F.array(*[F.lit(c).cast("long") for c in cuts])
    shard = F.aggregate(firsts, F.lit(0), lambda n, first: n + F.when(F.col("key") >= first, 1).otherwise(0))
    parts = max(8, shuffle_partitions(docs.sparkSession) // 4)
    placed = rows.withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64("row_no"), F.lit(parts)).cast("int"))
    # counts by shard and part: shards * parts rows, whatever the data; a shard's rows never meet in one task
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    in_part = Window.partitionBy("shard", "part").orderBy("key", "row_no")
    return (
        placed.withColumn("nth", F.row_number().over(in_part) - 1)
        .join(firsts, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first_slot") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
