"""A training corpus from the documents table, in five stages; each one's result is written and is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import exact_dedup, mixing, ngram_join, quality_classifier, sentencepiece_codec
from leafmill.llm.shared import discard, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often, and as far, as the mix of their sources takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with an end id, their number, and the digest of the text that the ids decode to."""
    coded = sentencepiece_codec.code_documents(docs, sentencepiece_codec.default_model())
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]

#: The classifier's decisions and the mix's draws are beyond SQL; tests/llm/test_pipeline.py holds each stage's rows
#: against what its operator, the library or a plain walk over all rows says.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's input is a written table, deleted when the next one is written.

    Null texts count as empty, and null ids, sources and langs are values like others, as the stages' operators define;
    without documents there is no result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, f"stage-{n + 1}")
            if before is not None:
                discard(before)
            before = docs
    return docs
