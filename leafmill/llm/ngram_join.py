"""N-gram Jaccard join by a MinHash LSH forest.

Every text's word shingles get a MinHash signature of TREES labels, each of DEPTH values. A tree is the prefix trie of
its labels in order. Matching descends by prefix length: it begins with whole labels, texts that share one in any tree
are candidates, and every pair of candidates is verified exactly on its shingles. The verified pairs measure how
many a prefix length misses: pairs are counted by bands of similarity, and prefixes are shortened until, for every band,
texts that are as similar meet in some tree with the target recall. Bands without a pair count with the most pairs that
could have been missed by chance, which must be few of all that were found (see enough()). A shorter prefix adds only
the pairs that shared no longer one, and tries are path-compressed: a node whose members all share the longer prefix
adds none and is passed over.

What keeps it bounded: texts of equal shingles are one class from the start, which carries how many rows it stands
for. A trie node of any size leaves one link for each member, found in salted parts; linked texts make candidate groups.
A group is cut into blocks of about BLOCK classes, and two blocks are verified in a task of their own: memory is two
blocks, and what leaves a task is a count for each class and a link that joins it to another, not the pairs. A class is
sent to another block only if it shares a node with a class there, so that texts that a chain of others joins don't meet.

Shingles are five words (a text of one to four words has one shingle, the whole), hashed to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship_code
from .labelled import KEPT_WORDS, Words, few_rows, split_words
from .shared import discard, text_or_empty, written

SIZE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL, BANDS = 16, 8, 0.995, 4
BLOCK, SALTS = 256, 16
#: Bits for each candidate, and at most, of the filter that keeps other texts out of the shuffle: 16 MB, whatever the data.
FILTER_BITS, MOST_BITS, PART_BITS = 16, 1 << 27, 1 << 15
SEED = 20240611
ODD = np.uint64(0x9E3779B97F4A7C15)


def bands(threshold: float) -> list[float]:
    """The least similarity of each band from the threshold to 1."""
    return [threshold + (1 - threshold) * k / BANDS for k in range(BANDS)]


def missed(similarity: float, depth: int) -> float:
    """The chance that two texts share no prefix of this length in any tree."""
    return (1 - similarity**depth) ** TREES


def enough(found: list[int], depth: int, recall: float = RECALL, threshold: float = THRESHOLD) -> bool:
    """Whether prefixes of this length reach the recall, as the pairs found so far in each band tell.

    A band with pairs must reach it for its least similarity. Of a band without any, n pairs would all have been missed
    with a chance of missed ** n: the pairs lost to that chance are missed at most, and may be no more than the recall
    allows of all pairs found. So with few pairs every band must reach the recall.
    """
    allowed = 1 - recall
    return all(missed(low, depth) <= allowed * (1 if n else max(1, sum(found))) for n, low in zip(found, bands(threshold), strict=True))


def shortened(found: list[int], depth: int, recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    """The longest prefix, of `depth` at most, that is enough."""
    while depth > 1 and not enough(found, depth, recall, threshold):
        depth -= 1
    return depth


class Hashes(Words):
    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: Hashes, text: str, size: int = SIZE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; empty for a text without words."""
    found = split_words(text)
    words = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    if not len(words):
        return words
    width = min(size, len(words))
    count = len(words) - width + 1
    total = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        total = _mixed(total * ODD + words[k : k + count] + np.uint64(k + 1))
    return np.unique(total)


_rng = np.random.Generator(np.random.PCG64(SEED))
_A = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, TREES * DEPTH) MinHash values of 32 bits, DEPTH for each tree; sets must not be empty."""
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    out = np.empty((len(sets), TREES * DEPTH), dtype=np.uint32)
    first = 0
    while first < len(sets):  # as many sets together as make some 60,000 shingles
        last = min(len(sets), max(first + 1, int(np.searchsorted(bounds, bounds[first] + 60_000))))
        flat = np.concatenate(sets[first:last])
        starts = bounds[first:last] - bounds[first]
        for v in range(TREES * DEPTH):
            x = flat * _A[v] + _B[v]
            out[first:last, v] = np.minimum.reduceat((x ^ (x >> np.uint64(29))) >> np.uint64(32), starts)
        first = last
    return out


def node_ids(labels: np.ndarray, depth: int) -> np.ndarray:
    """(sets, trees) 64-bit ids of the trie nodes at this depth; labels: (sets, TREES, DEPTH)."""
    total = np.zeros(labels.shape[:2], dtype=np.uint64) + np.arange(1, TREES + 1, dtype=np.uint64)
    for d in range(depth):
        total = _mixed(total * ODD + labels[:, :, d])
    return total


def _signed(docs: DataFrame) -> DataFrame:
    """row_no, doc_id, digest, key, set_hash (null without words), labels (of each tree, big-endian) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in few_rows(batches):
            sets = [shingles(hashes, t) for t in batch.column(2).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            set_hash: list = [None] * len(sets)
            labels: list = [None] * len(sets)
            if some:
                raw = signature([sets[i] for i in some]).astype(">u4").tobytes()
                size = 4 * DEPTH
                for k, i in enumerate(some):
                    set_hash[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    labels[i] = [raw[at : at + size] for at in range(k * TREES * size, (k + 1) * TREES * size, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(set_hash, type=pa.binary()), pa.array(labels, type=pa.list_(pa.binary()))],
                names=["row_no", "doc_id", "digest", "key", "set_hash", "labels"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"row_no long, doc_id {kind}, digest binary, key long, set_hash binary, labels array<binary>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root: the smallest node of its connected component, for every node of edges (a, b: long, no nulls).

    Edges point down, from the larger node to the smaller. In each round every node hooks on the smallest node that it
    points to, the trees that arise are flattened, and the edges move to their roots; those within a tree vanish. Of
    the nodes that still have edges at most half are left after two rounds. A node links to few (its hooks come first,
    so a hub's edges vanish in the first round), minima are combined before the shuffle, and each round is a written
    table. Without edges, no rows.
    """
    left = written(_pointed(edges), f"{name}-edges")
    total, rounds = None, 0
    while total is None or not left.isEmpty():
        rounds += 1
        hooks = left.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(left.select(F.col("b").alias("node"), F.col("b").alias("root")))
        trees = _flattened(hooks.groupBy("node").agg(F.min("root").alias("root")), f"{name}-{rounds}")
        upper = trees.select(F.col("node").alias("upper"), F.col("root").alias("a"))
        lower = trees.select(F.col("node").alias("lower"), F.col("root").alias("b"))
        # most edges lead to the root of the tree that they made: these are gone before the second join
        moved = left.withColumnsRenamed({"a": "upper", "b": "lower"}).join(upper, "upper").where("a != lower").join(lower, "lower").where("a != b")
        rest = written(_pointed(moved), f"{name}-edges-{rounds}")
        if total is None:
            total = trees
        else:
            further = trees.select(F.col("node").alias("root"), F.col("root").alias("further"))
            wider = written(total.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root")), f"{name}-all-{rounds}")
            discard(total)
            discard(trees)
            total = wider
        discard(left)
        left = rest
    discard(left)
    return total


def _pointed(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _flattened(trees: DataFrame, name: str) -> DataFrame:
    """trees (node, root), a written table, with the root of all in place of the node that each hooks on."""
    trees, rounds = written(trees, f"{name}-hooks"), 0
    while True:
        rounds += 1
        above = trees.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = written(trees.join(above, "root").select("node", F.col("root").alias("old"), F.col("further").alias("root")), f"{name}-jump-{rounds}")
        discard(trees)
        trees = jumped.select("node", "root")
        trees._leafmill_path = jumped._leafmill_path
        if jumped.where("old != root").isEmpty():
            return trees


def _verify(blocks: DataFrame, depth: int, longer: int | None, threshold: float) -> DataFrame:
    """class_no, links (rows in other classes that are as similar), to (a class that it joins) of every two blocks; and
    with null in these, bands: how many pairs of each band of similarity two blocks have."""

    def of_group(hashes: Hashes, key: tuple, rows: dict) -> tuple[list, list, list, list]:
        first, second = key[1:]
        one: dict[int, int] = {}
        for i, c in enumerate(rows["class_no"]):
            one.setdefault(c, i)  # rows repeated in id and text
        order = [one[c] for c in sorted(one)]
        number, block, weight = (np.array([rows[name][i] for i in order], dtype=np.int64) for name in ("class_no", "block", "weight"))
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        labels = np.frombuffer(b"".join(x for i in order for x in rows["labels"][i]), dtype=">u4").reshape(len(order), TREES, DEPTH).astype(np.uint32)
        meets = _sharing(node_ids(labels, depth), a, b)
        if longer:
            meets &= ~_sharing(node_ids(labels, longer), a, b)  # verified before
        if first == second:
            meets &= a[:, None] < b[None, :]
        if not meets.any():
            return [], [], [], []
        sets: list = [None] * len(order)
        for k in {*a[meets.any(axis=1)].tolist(), *b[meets.any(axis=0)].tolist()}:
            sets[k] = shingles(hashes, rows["text"][order[k]])
        likeness = similar(sets, a, b, meets, threshold)
        linked = likeness > 0
        links = np.zeros(len(order), dtype=np.int64)
        np.add.at(links, a, (linked * weight[b]).sum(axis=1))
        np.add.at(links, b, (linked * weight[a][:, None]).sum(axis=0))
        to = number.copy()
        while True:  # the smallest class that links lead to here, for each
            old = to.copy()
            for i, j, on in ((a, b, linked), (b, a, linked.T)):
                to[i] = np.minimum(to[i], np.where(on, to[j][None, :], np.iinfo(np.int64).max).min(axis=1))
            if np.array_equal(old, to):
                break
        some = links > 0
        in_band = np.histogram(likeness[linked], [*bands(threshold), np.inf])[0]
        return number[some].tolist(), links[some].tolist(), to[some].tolist(), in_band.tolist()

    names = ["root", "first", "second", "block", "class_no", "weight", "labels", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, rows = Hashes(), None, {n: [] for n in names[3:]}
        out: list = [[], [], [], []]

        def add() -> None:
            if key is None:
                return
            number, links, to, in_band = of_group(hashes, key, rows)
            for column, x in zip(out, (number, links, to, [None] * len(number)), strict=True):
                column += x
            if number:
                for column, x in zip(out, (None, None, None, in_band), strict=True):
                    column.append(x)

        def given() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=["class_no", "links", "to", "bands"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:  # in the order of the groups
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            for i, own in enumerate(zip(columns["root"], columns["first"], columns["second"], strict=True)):
                if own != key:
                    add()
                    key, rows = own, {n: [] for n in names[3:]}
                for n in names[3:]:
                    rows[n].append(columns[n][i])
            if out[0]:
                yield given()
        add()
        if out[0]:
            yield given()

    keys = names[:3]
    return blocks.select(names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "class_no long, links long, to long, bands array<long>")


def _sharing(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a and b share a node."""
    meets = np.zeros((len(a), len(b)), dtype=bool)
    for t in range(nodes.shape[1]):
        meets |= nodes[a, t][:, None] == nodes[b, t][None, :]
    return meets


def similar(sets: list, a: np.ndarray, b: np.ndarray, meets: np.ndarray, threshold: float) -> np.ndarray:
    """The exact Jaccard similarity of the pairs of meets that have the threshold or more, 0 for all others. Sets that
    are in no pair may be None."""
    size = np.array([0 if s is None else len(s) for s in sets], dtype=np.int64)
    likeness = np.zeros(meets.shape)
    # |x & y| <= min(|x|, |y|), so sizes alone rule pairs out
    small, large = np.minimum(size[a][:, None], size[b][None, :]), np.maximum(size[a][:, None], size[b][None, :])
    meets = meets & (small >= threshold * large - 1e-9)
    pairs = np.argwhere(meets)
    if not len(pairs):
        return likeness
    if len(pairs) <= 4 * (len(a) + len(b)):  # few: one by one
        for i, j in pairs:
            common = len(np.intersect1d(sets[a[i]], sets[b[j]], assume_unique=True))
            union = size[a[i]] + size[b[j]] - common
            if common >= threshold * union - 1e-9:
                likeness[i, j] = common / union
        return likeness
    used = np.unique(np.concatenate([a[meets.any(axis=1)], b[meets.any(axis=0)]]))
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), size[used])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    new = np.cumsum(count > 1) - 1
    column, owner, width = new[column[shared]], owner[shared], int((count > 1).sum())
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    common = np.zeros(meets.shape, dtype=np.float32)
    ua, ub = np.flatnonzero(place[a] >= 0), np.flatnonzero(place[b] >= 0)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, width, 4096):  # so many shingles at a time: memory stays bounded
        lo, hi = np.searchsorted(column, [start, start + 4096])
        matrix = np.zeros((len(used), min(4096, width - start)), dtype=np.float32)
        matrix[owner[lo:hi], column[lo:hi] - start] = 1
        common[np.ix_(ua, ub)] += matrix[place[a[ua]]] @ matrix[place[b[ub]]].T
    union = np.maximum(size[a][:, None] + size[b][None, :] - common, 1)
    return np.where(meets & (common >= threshold * union - 1e-9), common / union, 0.0)


def _salted(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _candidates(own: DataFrame, depth: int, longer: int | None) -> DataFrame:
    """class_no, root, block, first, second: which blocks of its candidate group meet a class at this prefix length. A
    written table.

    own: a written table of class_no and labels. longer: the prefix length whose pairs are known already.
    """
    label = F.posexplode("labels").alias("tree", "label")
    node = F.xxhash64("tree", F.substring("label", 1, 4 * depth))
    deeper = F.xxhash64(F.substring("label", 1, 4 * longer)) if longer else F.col("class_no")
    each = own.select("class_no", label).select("class_no", node.alias("node"), deeper.alias("deeper"), _salted("class_no").alias("salt"))
    # in two steps, so that no node meets in one task: members to the least of a salted part, these to the least of all
    parts = written(each.groupBy("node", "salt").agg(F.min("class_no").alias("low"), F.count(F.lit(1)).alias("n"), F.min("deeper").alias("d0"), F.max("deeper").alias("d1")), "parts")
    tops = parts.groupBy("node").agg(F.min("low").alias("top"), F.sum("n").alias("n"), F.min("d0").alias("d0"), F.max("d1").alias("d1")).where("n > 1 and d0 != d1").select("node", "top")
    live = parts.join(tops, "node").select("node", "salt", "low", "top")
    held = written(each.drop("deeper").join(live, ["node", "salt"]), "held")
    discard(parts)
    down = held.where("class_no != low").select(F.col("class_no").alias("a"), F.col("low").alias("b"))
    grouped = components(down.unionByName(held.where("low != top").select(F.col("low").alias("a"), F.col("top").alias("b"))).distinct(), "candidates")
    sizes = grouped.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    placed = grouped.join(sizes, "root").select(F.col("node").alias("class_no"), "root", "n_blocks", F.pmod(F.xxhash64("class_no"), F.col("n_blocks")).cast("int").alias("block"))
    placed = written(placed, "placed")
    alone = placed.where("n_blocks = 1").select("class_no", "root", "block", F.col("block").alias("other"))
    # a class meets a block with which it shares a node, its own if another class there does
    large = written(held.select("class_no", "node", "salt").join(placed.where("n_blocks > 1"), "class_no"), "large")
    there = large.groupBy("node", F.col("block").alias("other")).agg(F.count(F.lit(1)).alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    meeting = large.join(there, ["node", "salt"]).where("block != other or n > 1").select("class_no", "root", "block", "other").distinct()
    found = written(alone.unionByName(meeting).select("class_no", "root", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")), "meeting")
    discard(held, grouped, placed, large)
    return found


def _texts_of(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """class_no and text of the classes in wanted (class_no, id, sha, key: a written table), from source (doc_id, text).

    A filter over the keys, of a bounded size, keeps most other texts out of the shuffle.
    """
    bits = PART_BITS
    while bits < min(MOST_BITS, FILTER_BITS * max(1, wanted.count())):
        bits *= 2
    place = lambda c: F.pmod(c, F.lit(bits))
    parts = wanted.select(place(F.col("key")).alias("at")).select(F.floor(F.col("at") / PART_BITS).alias("part"), (F.col("at") % PART_BITS).alias("bit"))
    parts = F.broadcast(parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap")))
    near = source.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("at", place(F.col("key")))
    near = near.withColumn("part", F.floor(F.col("at") / PART_BITS)).join(parts, "part")
    byte = F.conv(F.hex(F.substr("bitmap", (F.col("at") % PART_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = near.where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1).select("doc_id", "text", "key")
    same = (F.col("own_key") == F.col("key")) & (F.unhex(F.sha2("text", 256)) == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("id"))
    return near.join(wanted.withColumnRenamed("key", "own_key"), same).select("class_no", "text")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links, copy_id, digest (SHA-256 of the text, binary).

    class_id: the smallest doc_id that a row is joined to by links, its own included; n_links: how many other rows
    have a similarity of the threshold or more, rows of equal shingles included; copy_id: the smallest doc_id of rows
    with equal shingles. Null texts count as empty; texts without words have no links and are classes of their own
    (class_id is their doc_id). Null ids count as larger than any; repeated rows are rows. No row, no result. Other
    columns of docs are not looked at.
    """
    ship_code(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    # row numbers are given once, here; texts are found again by id and digest
    numbered = source.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("doc_id", "text").alias("key"))
    signed = written(_signed(numbered), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no"))
    # a class is numbered by the row_no of its smallest id
    classes = written(
        signed.where("set_hash is not null").groupBy("set_hash").agg(least.alias("least"), F.count(F.lit(1)).alias("weight"))
        .select("set_hash", F.col("least.row_no").alias("class_no"), F.col("least.doc_id").alias("copy_id"), "weight"),
        "classes",
    )
    first_rows = signed.select(F.col("row_no").alias("class_no"), F.col("doc_id").alias("id"), F.col("digest").alias("sha"), "key", "labels")
    own = written(first_rows.join(classes.select("class_no", "weight"), "class_no"), "own")
    depth, longer, rounds = DEPTH, None, []
    while True:
        meeting = _candidates(own, depth, longer)
        wanted = written(own.join(meeting.select("class_no").distinct(), "class_no"), "wanted")
        blocks = _texts_of(source, wanted.select("class_no", "id", "sha", "key")).join(wanted.select("class_no", "weight", "labels"), "class_no").join(meeting, "class_no")
        rounds.append(written(_verify(blocks, depth, longer, threshold), f"found-{depth}"))
        discard(meeting, wanted)
        in_bands = [t.agg(*[F.sum(F.get("bands", F.lit(k))).alias(f"b{k}") for k in range(BANDS)]).first() for t in rounds]
        shorter = shortened([sum(r[k] or 0 for r in in_bands) for k in range(BANDS)], depth, recall, threshold)
        if shorter == depth:
            break
        depth, longer = shorter, depth
    discard(own)
    found = reduce(DataFrame.unionByName, rounds).where("class_no is not null")
    links = found.groupBy("class_no").agg(F.sum("links").alias("links"))
    joined = components(found.where("class_no != to").select(F.col("class_no").alias("a"), F.col("to").alias("b")), "links")
    ids = classes.select("class_no", "copy_id", "set_hash", "weight")
    named = (
        ids.join(links, "class_no", "left")
        .join(joined.withColumnRenamed("node", "class_no"), "class_no", "left")
        .withColumn("root", F.coalesce("root", "class_no"))
    )
    smallest = named.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNull().alias("none"), F.col("copy_id").alias("id"))).alias("least")).select("root", F.col("least.id").alias("class_id"))
    named = written(
        named.join(smallest, "root").select("set_hash", "copy_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")),
        "named",
    )
    discard(classes, joined, *rounds)
    # rows of equal shingles may be a third of all: salted
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        signed.select("doc_id", "digest", "set_hash", F.pmod(F.xxhash64("row_no"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(salted, ["set_hash", "salt"], "left")
        .select(
            "doc_id", F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), "digest",
        )
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, with one row of each class of near_duplicates(): that of the class id. All columns as they are.

    Rows that repeat in id and text are one. Ids are taken to name texts: where one id has several texts in a class,
    all these stay.
    """
    found = written(near_duplicates(docs, id_col, text_col, **options), "near")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id"))
    drop = found.where(~stays).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__sha")).distinct()
    digest = F.unhex(F.sha2(text_or_empty(text_col), 256))
    left = docs.join(drop, (digest == F.col("__sha")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
    if found.where(stays).groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        return left
    return left.withColumn("__sha", digest).dropDuplicates([id_col, "__sha"]).drop("__sha")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("digest")
