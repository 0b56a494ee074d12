"""Exact dedup, sharding, mixing, quality rules and chat formatting against brute force, and their edge cases."""

import collections
import hashlib
import math
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import chat_format, exact_dedup, mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, lang string, kept boolean, row_no long, size string"
ROWS = [
    (1, "a b c", "s1", "en", True, 1, "x"), (2, "a b c", None, None, None, None, None), (3, None, "s1", "en", False, 9, "y"), (4, "", "s2", None, True, 9, None),
    (None, "a b c", "s2", "en", True, 0, "z"), (7, "dup", "s1", "en", True, 0, "z"), (7, "dup", "s1", "en", True, 0, "z"), (8, "w " * 40_000, "s3", "en", True, 0, "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, empty):
    got = exact_dedup.duplicate_groups(docs, fan_in=2).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(ROWS)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
    assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 7, 8]
    assert exact_dedup.duplicate_groups(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            at, used = (at + s, used) if at + s <= mid else (s, used + 1)
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_sharding_finds_the_least_capacity(spark, shards):
    rows = [(i, "t" * ((i * 7919) % 300) + str(i // 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df, shards).collect()
    groups = collections.defaultdict(int)
    for _, t in rows:
        groups[int(hashlib.sha256(t.encode()).hexdigest()[:15], 16)] += len(t.encode()) + 16
    least = brute_capacity([groups[k] for k in sorted(groups)], shards)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.text_crc32 == zlib.crc32(dict(rows)[r.doc_id].encode())
    assert max(sum(r["size"] for r in v) for v in by.values()) <= least
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    where = {}
    for r in got:
        assert where.setdefault(dict(rows)[r.doc_id], r.shard) == r.shard


def test_sharding_edges(docs, empty):
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == len(ROWS) and {r.law for r in got} == {"bytes"}
    assert sharding.shard_documents(empty).count() == 0


def test_mix_targets():
    # 450 by 3, 1, 2 is 225, 75, 150; the first stops at 200, and its 25 go to the others by 1, 2
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    # 3015 by 3, 1, 2: the first stops at 20, the others get 2995 by 1, 2
    assert mixing.targets([10, 1000, 1000]) == pytest.approx([20, 2995 / 3, 2995 * 2 / 3])
    assert mixing.targets([100, 10, 10]) == pytest.approx([140, 20, 20]) and mixing.targets([50]) == [75]
    # 27 by 3, 1, 2, 3: the second has nothing to give, the others get 10.125, 6.75, 10.125
    assert mixing.targets([6, 0, 6, 6]) == pytest.approx([10.125, 0, 6.75, 10.125])


def test_mix_is_the_same_under_any_settings_and_layout(spark, monkeypatch):
    monkeypatch.setattr("leafmill.llm.shared.BUCKET_ROWS", 20)  # several buckets more than the least
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 97)), f"s{i % 3}") for i in range(600)]
    results = []
    for partitions, files, order in (("4", 1, 1), ("64", 7, -1)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = spark.createDataFrame(rows[::order], "doc_id long, text string, source string").repartition(files)
        results.append((sorted(map(tuple, mixing.mix_words(df, block=16).collect())), sorted(map(tuple, mixing.mix_documents(df, block=16).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    df = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="3 sources"):
        mixing.mix_words(df)
    assert mixing.mix_words(df.where("doc_id < 3")).count() == 3


def test_taken_blocks_equal_a_plain_walk(spark):
    """Which words are taken, against a walk over blocks in the order that running_totals() gives."""
    rows = [(i, " ".join(f"w{k}" for k in range(i % 23)), f"s{i % 2}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in mixing.mix_words(df, block=8, shards=5).collect()}
    mix = mixing.Mix(mixing.written(mixing._rows(df, F.monotonically_increasing_id(), "doc_id", "text", "source"), "walk"), block=8, shards=5)
    first = {r.doc_id: (r.source_no, r.first_word) for r in mix.rows.collect()}
    for source in (0, 1):
        at = 0
        for i in sorted((i for i in first if first[i][0] == source), key=lambda i: (first[i][1], i % 23)):
            assert first[i][1] == at
            at += i % 23
    table = mixing.draw_slots(mix.goals, mix.sizes, 8, 5)
    want = collections.Counter()
    for source, count in enumerate(table.sum(axis=0).tolist()):
        n = -(-mix.sizes[source] // 8)
        for k in range(count):
            block = int(mixing.permuted(mixing.np.array([k % n]), n, mixing.SEED + 2 * source + k // n)[0])
            for i, (s, begin) in first.items():
                if s == source:
                    want[i] += max(0, min(begin + i % 23, block * 8 + 8) - max(begin, block * 8))
    assert got == {i: want[i] for i in first}


def test_sharding_splits_ranges_to_the_last_bit(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 56)  # 56 and 6 more would be beyond the key
    rows = [((5 << 4) + i, 10 + i) for i in range(8)] + [((1 << 50) + i, 25) for i in range(4)]
    groups = spark.createDataFrame(rows, "key long, bytes long")
    capacity, cuts = sharding.plan_cuts(groups, 3)
    assert capacity == brute_capacity([b for _, b in sorted(rows)], 3) and len(cuts) == 2


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutations_are_permutations(n):
    import numpy as np

    with np.errstate(over="ignore"):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))


def test_mixing(spark, docs, empty):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 97)), f"s{i % 4}" if i % 5 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_words(df, block=16).collect()
    again = mixing.mix_words(df, block=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    taken, target = collections.Counter(), {}
    for r in got:
        assert r["size"] == len(WORD.findall(rows[r.doc_id][1])) and r.taken <= 2 * r["size"]
        taken[rows[r.doc_id][2]] += r.taken
        target[rows[r.doc_id][2]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 32 for s in target)
    words = mixing.mix_documents(df, block=16).select(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != "")))).first()[0]
    assert words == sum(taken.values())
    assert mixing.mix_words(docs).count() == len(ROWS)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_words(empty).count() == mixing.mix_documents(empty).count() == 0


def brute_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    cover = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark, docs, empty):
    texts = ["a b c a b c", "x\ny\nx\n \n \n", " ", None, "é#*$ %&|<> z", "a a a a a", "  b", "p q r\x0bp q r s t p q r", *["good words here " + " ".join(f"k{i}{j}" for j in range(80)) for i in range(6)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(8, 14)], "doc_id long, quality int")
    for r in quality_rules.apply_rules(df, labels).collect():
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (r.doc_id >= 8)
    none = labels.where("doc_id < 0")
    assert quality_rules.apply_rules(docs, none).count() == len(ROWS)
    assert quality_rules.apply_rules(empty, none).count() == 0


def test_chat_format(spark):
    rows = [(5, i, ["system", "user", "assistant"][min(i, 1) + (i > 1 and i % 2 == 0)], "t\\<|im_end|>\n" * (i * 13 % 70)) for i in range(40)]
    rows += [(6, 0, "assistant", ""), (6, 1, None, None), (6, 1, None, None), (6, None, "a\nb<|", "c\\"), (None, 0, "assistant", "x" * 40_000), (None, 1, "user", "y")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat_format.windows(df, budget=400)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    conversations = collections.defaultdict(list)
    for c, n, role, text in rows:
        conversations[c].append((-1 if n is None else n, role or "", text or ""))
    assert set(got) == set(conversations)
    for c, turns in conversations.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = windows.where("conv_id = 5").orderBy("window").collect()
    assert all(w.text.startswith("<|im_start|>system\n") for w in made) and len(made) > 3
    assert all(w.n_tokens <= 400 or w.n_turns - w.n_repeated == 1 for w in made)
    assert chat_format.windows(df.where("false")).count() == 0


def brute_windows(turns, budget, history):
    """Numbers of the turns of each window: repeated ones, own ones. turns: (tokens, is system) in order."""
    system = turns[0][0] if len(turns) > 1 and turns[0][1] else 0
    left, at = max(budget - system, 0), 1 if system else 0
    span, total, found = max(1, (left - left // 4) // 2), 0, {}
    for i in range(at, len(turns)):
        total += turns[i][0]
        found.setdefault(((total - 1) // span, turns[i][0] <= span), []).append(i)
    out = []
    for own in (found[k] for k in sorted(found)):
        spent, again = sum(turns[i][0] for i in own), []
        for i in range(own[0] - 1, max(at, own[0] - history) - 1, -1):
            if spent + turns[i][0] > left:
                break
            spent += turns[i][0]
            again.insert(0, i)
        out.append((again, own, spent + system))
    return out


def test_chat_windows_keep_the_budget_and_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_TURNS", 4)  # conversations of many parts
    import random

    rng = random.Random(4)
    rows = []
    for c in range(60):
        role = rng.choice(["system", "user"])
        rows.append((c, 0, role, f"<{c}.0>" + "s" * rng.choice([0, 10, 400, 900, 1500, 3000])))
        rows += [(c, i, ["user", "assistant"][i % 2], f"<{c}.{i}>" + "t" * rng.choice([0, 20, 20, 100, 300, 1700])) for i in range(1, rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    budget, history = 400, 3
    made = collections.defaultdict(list)
    for w in chat_format.windows(df, budget, history).collect():
        made[w.conv_id].append(w)
    for c in range(60):
        mine = [(r, t) for i, _, r, t in rows if i == c]
        turns = [(-(-(len(r) + len(t)) // 4) + 4, r == "system") for r, t in mine]
        want = brute_windows(turns, budget, history)
        got = sorted(made[c], key=lambda w: w.window)
        system = len(mine) > 1 and mine[0][0] == "system"
        assert len(got) == len(want)
        for n, (w, (again, own, tokens)) in enumerate(zip(got, want, strict=True)):
            said = [int(x) for x in re.findall(rf"<{c}\.(\d+)>", w.text)]
            assert said == ([0] if system else []) + again + own
            assert (w.n_tokens, w.n_turns, w.n_repeated) == (tokens, len(said), len(again) + (system and n > 0))
            assert [w.text[s.start : s.start + s.length] for s in w.loss] == [mine[i][1] for i in own if mine[i][0] == "assistant"]
            assert w.n_tokens <= budget or len(own) == 1 and not again


def test_chat_takes_a_counter_of_tokens(spark):
    df = spark.createDataFrame([(1, i, "user", "a b c") for i in range(10)], "conv_id long, turn long, role string, text string")
    got = chat_format.windows(df, budget=16, history=0, tokens=lambda role, text: F.size(F.split(text, " "))).collect()
    assert sum(w.n_tokens for w in got) == 30 and max(w.n_tokens for w in got) <= 16


def brute_scores(texts, trusted):
    """Log-likelihood ratios of hashed 1- and 2-grams, with weights in millionths, as the docstring of quality_rules says."""
    half = quality_rules.BUCKETS // 2

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def buckets(words):
        one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        two = [xxhash.xxh64_intdigest(w.encode(), h) for h, w in zip(one, words[1:], strict=False)]
        return [signed(h) % half for h in one] + [signed(h) % half + half for h in two]

    held = [buckets(WORD.findall(t)) for t in texts]
    raw, good = collections.Counter(), collections.Counter()
    for i, b in enumerate(held):
        raw.update(b)
        good.update(b if i in trusted else ())
    n, t = sum(raw.values()) + quality_rules.BUCKETS, sum(good.values()) + quality_rules.BUCKETS
    weight = {b: round((math.log((good[b] + 1) / t) - math.log((raw[b] + 1) / n)) * 1e6) for b in raw}
    return [sum(weight[b] for b in x) / max(1, len(x)) / 1e6 for x in held]


def test_the_ratio_alone_rejects_and_equals_brute_force(spark):
    """Documents without a base failure: some like the trusted ones, some of other words."""
    import random

    rng = random.Random(6)
    usual, other = [f"word{i}" for i in range(300)], [f"other{i}" for i in range(300)]
    texts = [" ".join(rng.sample(usual, 80)) for _ in range(60)] + [" ".join(rng.sample(other, 80)) for _ in range(40)]
    trusted = set(range(40))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in trusted)) for i in range(50)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.apply_rules(df, labels).collect()}
    counted = F.pmod(F.xxhash64("doc_id", F.lit("counted")), F.lit(2)) == 0
    half = {r.doc_id for r in df.where(counted).collect()} & trusted
    scores = brute_scores(texts, half)
    known = [scores[i] for i in trusted - half]
    mean = sum(known) / len(known)
    deviation = (sum(x * x for x in known) / len(known) - mean**2) ** 0.5
    threshold = mean - max(quality_rules.SPREAD * deviation, quality_rules.LEAST_MARGIN)
    assert not any(r.base_failed for r in got.values())
    for i, score in enumerate(scores):
        assert got[i].score == pytest.approx(score, abs=1e-9)
        assert got[i].kept == (score >= threshold) == (i < 60)


def test_every_trusted_document_counts(spark):
    """More labels of quality 1 than were once looked at, of few documents: each of these is counted or gives the threshold."""
    import random

    rng = random.Random(8)
    usual, other = [f"word{i}" for i in range(200)], [f"other{i}" for i in range(200)]
    texts = [" ".join(rng.sample(usual, 60)) for _ in range(90)] + [" ".join(rng.sample(other, 60)) for _ in range(30)]
    trusted = set(range(60)) | set(range(90, 95))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.range(1_000, 60_000).union(spark.createDataFrame([(i,) for i in sorted(trusted)], "id long")).selectExpr("id AS doc_id", "1 AS quality")
    labels = labels.union(labels.where("doc_id < 30"))  # repeated labels count once
    counted = F.pmod(F.xxhash64("doc_id", F.lit("counted")), F.lit(2)) == 0
    half = {r.doc_id for r in df.where(counted).collect()} & trusted
    scores = brute_scores(texts, half)
    known = [scores[i] for i in trusted - half]
    mean = sum(known) / len(known)
    deviation = (sum(x * x for x in known) / len(known) - mean**2) ** 0.5
    threshold = mean - max(quality_rules.SPREAD * deviation, quality_rules.LEAST_MARGIN)
    got = {r.doc_id: r for r in quality_rules.apply_rules(df, labels).collect()}
    assert len(got) == len(texts)
    for i, score in enumerate(scores):
        assert got[i].score == pytest.approx(score, abs=1e-9)
        assert got[i].kept == (score >= threshold)


@pytest.mark.parametrize("slots", [8, 1 << 16, 1 << 23])
def test_trusted_ids_are_found_whatever_the_bitmap_holds(spark, monkeypatch, slots):
    monkeypatch.setattr(quality_rules, "SLOTS", slots)
    ids = spark.range(0, 3_000, 3).withColumnRenamed("id", "trusted_id")
    docs = spark.range(1_000).selectExpr("IF(id % 10 = 0, NULL, id - id % 2) AS doc_id", "CAST(id AS string) AS text")
    for kind in ("long", "int", "string", "double"):  # ids of another type than the labels' have
        got = quality_rules.marked(docs.withColumn("doc_id", F.col("doc_id").cast(kind)), ids).collect()
        assert sorted(int(r.text) for r in got) == list(range(1_000))
        assert all(r.trusted == int(r.doc_id is not None and float(r.doc_id) % 3 == 0) for r in got)
