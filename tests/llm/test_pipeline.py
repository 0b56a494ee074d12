"""Stages of the pipeline against brute force: whole rows, decisions that take effect, and edge cases."""

import collections
import hashlib
import itertools
import re

import pytest

import corpus_pipeline
from leafmill.llm import mixing, quality_classifier, registry
from leafmill.llm.shared import written

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of documents and of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(written(stage(spark, tables[-1], SF), f"t{n}"))
    assert all(t.columns == docs.columns for t in tables[:5])
    return [t.collect() for t in tables]


def shingles(text):
    words = WORD.findall(text or "")
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def test_classifier_keeps_what_it_predicts_good(spark, stages):
    scored = quality_classifier.op5_quality_classifier(spark, SF).collect()
    good = {r.doc_id for r in scored if r.predicted == 1}
    assert sorted(stages[1]) == sorted(r for r in stages[0] if r.doc_id in good) and 0 < len(stages[1]) < len(stages[0])


def test_one_of_equal_texts_stays(stages):
    best = collections.defaultdict(list)
    for r in stages[1]:
        best[r.text or ""].append(r)
    assert sorted(stages[2]) == sorted(max(v, key=lambda r: r.doc_id) for v in best.values())


def test_one_of_each_near_group_stays(stages):
    rows, parent = sorted(stages[2], key=lambda r: r.doc_id), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([(r.doc_id, shingles(r.text)) for r in rows], 2):
        common = len(a[1] & b[1])
        if common and common >= 0.8 * (len(a[1]) + len(b[1]) - common) - 1e-9:
            x, y = sorted((find(a[0]), find(b[0])))
            parent[y] = x
    assert sorted(stages[3]) == sorted(r for r in rows if find(r.doc_id) == r.doc_id) and len(stages[3]) < len(stages[2])


def test_mix_is_what_was_taken(spark, stages):
    docs = spark.createDataFrame(stages[3], spark.read.parquet(f"{SF}/documents.parquet").schema)
    taken = {r.doc_id: r.taken for r in mixing.mix_words(docs).collect()}
    words, source = collections.Counter(), {r.doc_id: r for r in stages[3]}
    for r in stages[4]:
        words[r.doc_id] += len(WORD.findall(r.text or ""))
        whole = WORD.findall(source[r.doc_id].text or "")
        mine = WORD.findall(r.text or "")
        assert mine == whole or " ".join(mine) == r.text  # whole, or the words of blocks
    assert all(words[i] == n for i, n in taken.items())


def test_ids_are_the_library_s(stages):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter()
    for r in stages[4]:
        ids = [*library.encode(r.text or ""), 2]
        want[r.doc_id, r.lang, r.source, tuple(ids), len(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert want == collections.Counter((r.doc_id, r.lang, r.source, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in stages[5])


def test_run_takes_nulls_long_texts_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = [(i, f"w{i} " * 30, "en", "s", 100) for i in range(6)] + [(7, None, None, None, None), (None, "", "en", None, 0), (9, "x y " * 60_000, "en", "t", 240_000), (1, "w1 " * 30, "en", "s", 100)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert all(r.n_tokens == len(r.ids) and r.ids[-1] == 2 for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registry_names_every_operator():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{n}" for n in range(1, 11)}
