"""Joins, codec, classifiers and extraction against brute force, libraries and held-out labels, and their edge cases."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from leafmill.llm import ngram_join, quality_classifier, sentencepiece_codec, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, digest string, class_no long"
ROWS = [(1, "a b c d e f g", "s", "x", 1), (2, "a b c d e f g", None, None, None), (3, None, "s", "x", 1), (4, "", "s", "x", 1), (None, "a b", "s", "x", 1), (6, "a b", "s", "x", 1), (7, "w", "s", "x", 1), (7, "w", "s", "x", 1)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_jaccard_join_finds_what_brute_force_does(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # several blocks a group
    rng = random.Random(3)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 120))] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(rng.randrange(1, 8)):
            t = list(b)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = f"n{rng.randrange(9)}"
            texts.append(" ".join(t))
    texts += [" ".join(f"h{i}" if i != k else "odd" for i in range(100)) for k in range(45)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    links, parent = collections.Counter(), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    missed = [i for i in range(len(texts)) if got[i] != (find(i), links[i])]
    assert len(missed) <= len(texts) // 100


def test_jaccard_join_edges(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect())
    assert got == collections.Counter([(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0), (None, 6, 1), (6, 6, 1), (7, 7, 1), (7, 7, 1)])
    kept = ngram_join.keep_representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7]
    assert ngram_join.near_duplicates(df.where("false")).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    chain = rng.sample(range(200), 200)
    cases = [[], list(zip(chain, chain[1:], strict=False)), [(500, i) for i in range(200)], [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]]
    for pairs in cases:
        edges, parent = [p for p in pairs if p[0] != p[1]], {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for pair in edges:
            a, b = sorted(map(find, pair))
            parent[b] = a
        got = ngram_join.components(spark.createDataFrame([*edges, *edges], "a long, b long"), "test").collect()
        assert {r.node: r.root for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


def test_prefixes_shorten_until_measured_pairs_reach_the_recall():
    low, high = ngram_join.bands(0.8)[0], ngram_join.bands(0.8)[-1]
    # alike pairs alone need no shorter prefix; with few pairs, or with one at the threshold, prefixes shorten
    assert ngram_join.shortened([0, 0, 0, 1000], 8) == 8
    assert ngram_join.shortened([1, 0, 0, 1000], 8) == ngram_join.shortened([0, 0, 0, 0], 8) == 5
    assert ngram_join.shortened([0, 0, 0, 3], 8) == 6 or ngram_join.shortened([0, 0, 0, 3], 8) == 5
    for found in ([0, 0, 0, 0], [5, 5, 5, 5], [0, 2, 0, 300]):
        depth = ngram_join.shortened(found, 8)
        assert ngram_join.enough(found, depth) and (depth == 8 or not ngram_join.enough(found, depth + 1))
    assert ngram_join.missed(low, 5) <= 0.005 < ngram_join.missed(low, 6) and ngram_join.missed(high, 8) < 0.005


def brute_links(sets, threshold=0.8):
    """All pairs of indexes as similar as that, by counting common shingles over an inverted index."""
    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    common = collections.Counter(pair for v in held.values() for pair in itertools.combinations(v, 2))
    return [(i, j) for (i, j), n in common.items() if n >= threshold * (len(sets[i]) + len(sets[j]) - n) - 1e-9]


def test_jaccard_join_recall_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    links = collections.Counter(i for pair in brute_links([shingles(r.text) for r in docs]) for i in pair)
    got = {r.doc_id: r.n_links for r in ngram_join.op1_ngram_jaccard_join(spark, SF).collect()}
    want = {r.doc_id: links[i] for i, r in enumerate(docs)}
    assert all(got[i] <= want[i] for i in want)
    assert sum(links.values()) > 50 and sum(got.values()) >= 0.99 * sum(links.values())


def test_chains_send_classes_only_where_they_share_a_node(spark, monkeypatch):
    """A chain of texts, each like the next, is one class; a block of it meets only blocks that share a node with it."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    words = [f"w{i}" for i in range(1400)]
    texts = [" ".join(words[i * 10 : i * 10 + 300]) for i in range(110)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    links = collections.Counter(i for pair in brute_links(sets) for i in pair)
    rows = ngram_join.near_duplicates(df).collect()
    assert {r.class_id for r in rows} == {0}
    assert sum(r.n_links for r in rows) >= 0.99 * sum(links.values())


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.default_model())


def test_codec_equals_the_library(codec):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    texts = ["", " ", "▁", "a\n\tb", "</s><0x41>", "x" * 3000, " " * 300 + "y", "the end. " * 50]
    texts += ["".join(rng.choice("abcdeéß你  \n\t▁<>0😀,.THE!") for _ in range(rng.randrange(60))) for _ in range(1500)]
    for t in texts:
        ids = library.encode(t)
        assert codec.encode(t) == ids
        assert codec.decode([*ids, 2]) == library.decode([*ids, 2])


def test_search_equals_merging_in_runs_of_spaces(codec):
    """Their pieces have equal scores: every run up to 300 alone, and up to 40 between other characters."""
    space = sentencepiece_codec.SPACE
    texts = [space * n for n in range(1, 300)]
    texts += [a + space * n + b for n in range(1, 40) for a in ("", "the", "1", "}") for b in ("", "a", "the", "//")]
    assert all(codec.search(t) == codec.merge(t) for t in texts)
    assert codec.search(space * 50_000) == codec.search(space * 160) * 312 + codec.search(space * 80)


def test_codec_decodes_any_ids(codec):
    assert codec.decode([]) == "" and codec.decode([2]) == ""
    assert codec.decode([3 + 0xFF]) == "�"


def test_round_trip_edges(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    got = sentencepiece_codec.round_trip(df, sentencepiece_codec.default_model()).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (3, 4)} == {1}
    assert sentencepiece_codec.round_trip(df.where("false"), sentencepiece_codec.default_model()).count() == 0


def held_out(spark, f, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return [(r.predicted, labels[r.doc_id]) for r in f(spark, SF).collect() if r.held_out and r.doc_id in labels]


def test_quality_on_held_out_rows(spark):
    got = held_out(spark, quality_classifier.op5_quality_classifier, "quality")
    assert sum(p == y for p, y in got) >= 0.97 * len(got)


def test_toxicity_on_held_out_rows(spark):
    got = held_out(spark, toxicity.op8_toxicity, "toxic")
    assert sum(p == y for p, y in got) >= 0.88 * len(got)
    clean = [p for p, y in got if y == 0]
    assert sum(clean) <= 0.05 * len(clean)  # words that training never saw, and that begin like others, included


VILE, MILD = ["vileword", "vilenesses", "gruntles"], [f"{a}{b}" for a in ("plain", "water", "grass", "cloud") for b in "abcdefgh"]


def vile_texts(n, seed):
    """(text, label, where its vile words are): ordinary words, and in every fourth text a passage of vile ones."""
    rng = random.Random(seed)
    for i in range(n):
        words = rng.choices(MILD, k=rng.randrange(20, 60))
        at = rng.randrange(len(words)) if i % 4 == 0 else None
        if at is not None:
            words[at:at] = rng.choices(VILE[:2], k=6)
        yield " ".join(words), int(at is not None), at


@pytest.mark.parametrize("kind", ["long", "string"])
def test_learners_take_any_id_and_label_types(spark, kind):
    made = list(vile_texts(200, 1))
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(made)], "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, (_, y, _) in enumerate(made)], "doc_id long, toxic long, quality long").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "toxic", "quality")
    got = {int(r.doc_id): r for r in toxicity.score_documents(docs, labels).collect()}
    for i, (_, y, at) in enumerate(made):
        assert got[i].predicted == y and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        # the passage that is found is the one that was put in
        assert [(p.start, p.end) for p in got[i].passages] == ([(at, at + 6)] if y else [])
    good = {int(r.doc_id): r.predicted for r in quality_classifier.score_documents(docs, labels).collect()}
    assert sum(good[i] == 1 - y for i, (_, y, _) in enumerate(made)) >= 190


def test_token_scores_equal_brute_force(spark):
    made = list(vile_texts(120, 2))
    sample = spark.createDataFrame([(t, y, i % toxicity.FOLDS) for i, (t, y, _) in enumerate(made)], "text string, label int, part int")
    weights = toxicity.learn_weights(sample)
    assert len(weights) == toxicity.FOLDS + 1
    for model in (0, toxicity.FOLDS):
        mine = [(set(t.split()), y) for i, (t, y, _) in enumerate(made) if i % toxicity.FOLDS != model]
        base = np.mean([y for _, y in mine])

        def score(held, prior, mine=mine, base=base):
            y1, y0 = sum(y for h, y in mine if held(h)), sum(1 - y for h, y in mine if held(h))
            a, b = y1 + toxicity.PRIOR * prior, y0 + toxicity.PRIOR * (1 - prior)
            delta = np.log(a / b) - np.log(base / (1 - base))
            return y1, y0, delta, delta / np.sqrt(1 / a + 1 / b)

        for w in MILD + VILE:
            y1, y0, _, z = score(lambda h, w=w: w in h, base)
            s1, s0, stem_delta, stem_z = score(lambda h, w=w: any(x[:5] == w[:5] for x in h), base)
            own = score(lambda h, w=w: w in h, (s1 + toxicity.PRIOR * base) / (s1 + s0 + toxicity.PRIOR))[2]
            want = own if abs(z) >= toxicity.LEAST_Z or (abs(stem_z) >= toxicity.LEAST_Z and not (y0 and y1)) and y1 + y0 else toxicity.DRIFT
            assert weights[model][w] == pytest.approx(want)
        stem_delta, stem_z = score(lambda h: any(x.startswith("vilen") for x in h), base)[2:]
        assert weights[model]["vilenable"] == pytest.approx(stem_delta if abs(stem_z) >= toxicity.LEAST_Z else toxicity.DRIFT)
        assert weights[model]["unseen"] == toxicity.DRIFT


def test_quality_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "MOST_FEATURES", 4000)
    made = list(vile_texts(200, 3))
    docs = spark.createDataFrame([(i, t + " end" * 3000) for i, (t, *_) in enumerate(made)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y) for i, (_, y, _) in enumerate(made)], "doc_id long, quality int")
    assert quality_classifier.score_documents(docs, labels).count() == 200


def test_dual_descent_reaches_the_optimum_of_the_dual():
    """Against the duality gap: primal and dual objective meet."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)]
    label = np.array([int(r[0] < 4) for r in rows])
    values, cost = [np.ones(6) for _ in rows], np.full(80, 0.5)
    w = quality_classifier.dual_descent(rows, values, label, 30, cost, 2000)
    sign = np.where(label == 1, 1, -1)
    margin = np.array([w[r].sum() + w[-1] for r in rows]) * sign
    best = w @ w / 2 + (cost * np.maximum(0, 1 - margin)).sum()
    for _ in range(300):  # no step nearby does better
        v = w + rng.normal(0, 0.02, len(w))
        m = np.array([v[r].sum() + v[-1] for r in rows]) * sign
        assert v @ v / 2 + (cost * np.maximum(0, 1 - m)).sum() >= best - 1e-6


def test_classifier_edges(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false"), labels.where("doc_id = 1")):
        for f in (quality_classifier.score_documents, toxicity.score_documents):
            got = f(docs, some).collect()
            assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score_documents(docs.where("false"), labels).count() == 0
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns


def brute_segments(x):
    """Maximal scoring segments by their recursive definition."""
    best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return [*brute_segments(x[:i]), (i, j), *[(a + j, b + j) for a, b in brute_segments(x[j:])]]


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = rng.normal(-0.2, 1, rng.integers(0, 14))
        got = toxicity.segments(x)
        assert [(a, b) for a, b, _ in got] == brute_segments(list(x))
        assert all(abs(s - x[a:b].sum()) < 1e-9 for a, b, s in got)


def test_one_pass_codes_like_two(spark):
    model = sentencepiece_codec.default_model()
    rows = [(1, None, "x", [7], "A"), (2, "", None, None, "B"), (2, "", None, None, "B"), (3, "Hello  wörld\n ▁ 𝛼\x00", "y", [1], "C"), (None, "a " * 5000, "z", [1], "D")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, coded string, ids array<int>, decoded string")
    one = sentencepiece_codec.code_documents(docs, model)
    two = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs, model), model)
    assert one.columns == two.columns == docs.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert sentencepiece_codec.code_documents(docs.limit(0), model).count() == 0
