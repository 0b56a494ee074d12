"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams, in DataFrame operations only.

Two multinomials over hashed word 1-grams and 2-grams are estimated: one from the raw corpus, which is every document,
and one from trusted documents. A document's score is the log-likelihood ratio of its n-grams, divided by how many it
has. Weights are integers (millionths), so that sums don't depend on their order. Every document is held against one
threshold: SPREAD standard deviations below the mean of the trusted documents' scores, or LEAST_MARGIN below it if that
is lower. The margin is for large corpora, where trusted scores lie so close that a short clean text strays further.

Trusted are all documents of quality 1, however many. One half of them, by hash, gives the counts, and the other half
the mean and the deviation, so that these tell how documents score that were not counted. Where a half is empty, all
trusted documents give both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, SPACE_CHARS, text_or_empty, written

BUCKETS, SPREAD, LEAST_MARGIN = 1 << 17, 5.0, 0.15
#: Bits of the bitmap that tells which ids can't be trusted: 1 MB.
SLOTS = 1 << 23
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
UNIT = 1_000_000


def words_of(text: Column) -> Column:
    """The words in order; an empty array for none."""
    plain = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, f"{SPACE}+"))


def window_hashes(words: Column) -> Column:
    """A hash of each window of three words, in order."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _covered(hashes: Column) -> Column:
    """Words covered by the windows whose hash stands twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # one more name for the sorted array, so that it is computed once
    starts = F.transform(
        F.array(placed),
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"]
            )
        ),
    )
    total = F.transform(
        starts,
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
        ),
    )
    return F.get(total, F.lit(0))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words, and the base counts of every row."""
    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.char_length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    first = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    second = first.select(
        "doc_id", "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("words")).alias("hashes"),
    )
    found = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _covered(F.col("hashes"))).otherwise(F.lit(0))
    return second.withColumn("n_repeat_words", found.cast("long")).drop("hashes")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each word: keep, `one` and `two`, the buckets of its 1-gram and of the 2-gram that it begins (null at the end)."""
    pairs = F.arrays_zip(F.col("words"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))))
    each = rows.select(*keep, F.explode_outer(pairs).alias("p"))
    half = BUCKETS // 2
    return each.select(
        *keep,
        F.when(F.col("p.words").isNotNull(), F.pmod(F.xxhash64("p.words"), F.lit(half))).cast("int").alias("one"),
        F.when(F.col("p.1").isNotNull(), F.pmod(F.xxhash64("p.words", "p.1"), F.lit(half)) + half).cast("int").alias("two"),
    )


def bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket, n, t over the n-grams of rows (columns `words` and `trusted`, 0 or 1): at most BUCKETS rows."""
    each = _grams(rows, "trusted").select(F.explode(F.array("one", "two")).alias("bucket"), "trusted")
    return each.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("trusted").alias("t"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """bucket, weight: log of trusted against raw probability in millionths, both smoothed by one for each bucket."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    raw_total, trusted_total = (total["n"] or 0) + BUCKETS, (total["t"] or 0) + BUCKETS
    ratio = F.log((F.col("t") + 1) / trusted_total) - F.log((F.col("n") + 1) / raw_total)
    return counts.select("bucket", F.round(ratio * UNIT).cast("long").alias("weight"))


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) with `trusted`: 1 where doc_id is in ids (trusted_id, no repeats), else 0.

    There may be as many ids as rows, so that both meet in a shuffle. Rows whose hash no id has skip it: these are told
    by a bitmap of SLOTS bits. The more ids, the fewer rows skip it; the result doesn't depend on how many do.
    """
    slot = lambda c: F.pmod(F.xxhash64(c, F.lit("slot")), F.lit(SLOTS))
    either = F.lit(True)
    kinds = {dict(docs.dtypes)["doc_id"], dict(ids.dtypes)["trusted_id"]}
    if kinds in ({"bigint"}, {"int"}, {"string"}):  # equal ids have equal hashes
        at = slot("trusted_id")
        bits = ids.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        docs = docs.join(F.broadcast(bits), F.bitmap_bucket_number(slot("doc_id")) == F.col("part"), "left")
        place = F.bitmap_bit_position(slot("doc_id")).cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
        either = F.col("doc_id").isNotNull() & F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))
    docs = docs.select("doc_id", "text", either.alias("either"))
    met = docs.where("either").join(ids.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left")
    met = met.select("doc_id", "text", F.col("trusted_id").isNotNull().cast("int").alias("trusted"))
    return met.unionByName(docs.where("not either").select("doc_id", "text", F.lit(0).alias("trusted")))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, score.

    Null texts count as empty: no words, base_failed. Null ids can't be trusted but are judged like others; repeated
    rows are judged alike. Without trusted documents every score is about 0 and the base rules decide. No row, no
    result. Other columns of docs are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    counted = F.pmod(F.xxhash64("doc_id", F.lit("counted")), F.lit(2)) == 0
    # no bound on these, so they are shuffled, not broadcast
    trusted = good.select(F.col("doc_id").alias("trusted_id"), counted.alias("counted")).hint("merge")
    halves = {r.counted for r in docs.join(trusted, F.col("doc_id") == F.col("trusted_id")).select("counted").distinct().collect()}
    in_half = lambda first: (F.col("counted") == first) if len(halves) == 2 else F.col("trusted_id").isNotNull()
    split = marked(docs, trusted.where(in_half(True)).select("trusted_id")).select(words_of(text_or_empty("text")).alias("words"), "trusted")
    weights = written(log_ratios(written(bucket_counts(split), "counts")), "weights")
    rows = base_counts(docs).withColumn("row_no", F.monotonically_increasing_id())
    named = ["row_no", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    small = F.broadcast(weights)  # BUCKETS rows at most, whatever the data
    scored = (
        _grams(rows, *named)
        .join(small.select(F.col("bucket").alias("one"), F.col("weight").alias("w1")), "one", "left")
        .join(small.select(F.col("bucket").alias("two"), F.col("weight").alias("w2")), "two", "left")
        .groupBy("row_no")
        .agg(
            F.sum(F.coalesce("w1", F.lit(0)) + F.coalesce("w2", F.lit(0))).alias("sum"), F.count("two").alias("pairs"),
            *[F.first(c).alias(c) for c in named[1:]],
        )
        .withColumn("score", F.col("sum") / F.greatest(F.col("n_words") + F.col("pairs"), F.lit(1)) / UNIT)
        .withColumn("base_failed", base_failed())
        .drop("sum", "pairs")
    )
    scored = written(scored, "scores")
    known = scored.join(trusted.where(in_half(False)), F.col("doc_id") == F.col("trusted_id"), "left_semi").where("not base_failed")
    scaled = F.round(F.col("score") * UNIT).cast("decimal(20,0)")
    s = known.agg(F.count(F.lit(1)).alias("n"), F.sum(scaled).alias("x"), F.sum((scaled * scaled).cast("decimal(38,0)")).alias("xx")).first()
    threshold = -1e9
    if s["n"]:
        mean = float(s["x"]) / s["n"] / UNIT
        deviation = max(float(s["xx"]) / s["n"] / UNIT**2 - mean**2, 0.0) ** 0.5
        threshold = mean - max(SPREAD * deviation, LEAST_MARGIN)
    return scored.select(
        *named[1:], "base_failed", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
