from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from daytable.llm import neardup

DATA = "/root/testdata/sf0.01/documents.parquet"


def brute(texts: dict[int, str], least: float = 0.8) -> dict[int, int]:
    """Classes by the similarity of all pairs that share a shingle."""
    sets = {k: neardup.shingles(t.encode()) for k, t in texts.items()}
    holds = defaultdict(list)
    for k, (x, _) in sets.items():
        for e in x.tolist():
            holds[e].append(k)
    pairs = {(a, b) for ks in holds.values() if len(ks) > 1 for i, a in enumerate(ks) for b in ks[i + 1 :]}
    label = {k: k for k in texts}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in pairs:
        if neardup.similarity(sets[a], sets[b]) >= least - 1e-9:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {k: root(k) for k in texts}


def test_all_documents_against_brute_force(spark):
    docs = spark.read.parquet(DATA)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r["class_id"] for r in neardup.op3_prob_min_hash(spark, "/root/testdata/sf0.01").collect()}
    want = brute(texts)
    assert found == want
    assert any(k != v for k, v in want.items())


def test_registers_estimate_the_probability_jaccard_index():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(60):
        base = np.sort(rng.choice(2**60, 200, replace=False)).astype(np.uint64)
        w = rng.integers(1, 4, 200)
        v = w.copy()
        v[:20] = rng.integers(1, 6, 20)
        sets += [(base[:180], w[:180]), (base[10:], v[10:])]
    m = neardup.prob_min_hash(sets, 400)
    real = np.mean([neardup.similarity(a, b) for a, b in zip(sets[::2], sets[1::2], strict=True)])
    assert abs((m[::2] == m[1::2]).mean() - real) < 0.01


def test_similarity_by_its_definition():
    a = (np.array([1, 2, 3], np.uint64), np.array([1, 2, 1]))
    b = (np.array([2, 3, 4], np.uint64), np.array([1, 1, 3]))
    x, y = {1: 1, 2: 2, 3: 1}, {2: 1, 3: 1, 4: 3}
    want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in (1, 2, 3, 4)) for d in (2, 3))
    assert abs(neardup.similarity(a, b) - want) < 1e-12
    assert neardup.similarity(a, a) == 1


def test_nulls_empty_ties_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(5, long), (3, long + " end"), (3, long + " end"), (None, long), (7, None), (8, ""), (9, " \n"), (10, "a b"), (11, "a  b"), (12, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(neardup.near_duplicates(docs).collect(), key=repr)
    assert {(r["doc"], r["class_id"]) for r in found} == {(5, 3), (3, 3), (None, None), (7, 7), (8, 8), (9, 9), (10, 10), (11, 10), (12, 12)}
    assert len(found) == len(rows)
    kept = neardup.keep_first(docs.withColumn("words", F.lit(1)))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["10", "12", "3", "7", "8", "9", "None"]
    assert kept.columns == ["doc_id", "text", "words"]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_a_large_group_is_one_class_without_all_pairs(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(base[:k] + ["x"] + base[k:])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in neardup.near_duplicates(docs).collect()} == {0}


def class_of_each(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}


def test_pairs_in_a_crowd_that_shares_most_of_its_text(spark):
    """1,000 documents share 88 % of their text, so that bands are crowded; each 50th has a copy at 0.81 to 0.85 that is as far from it
    as the others but for a few words."""
    shared = [f"s{i}" for i in range(352)]
    rows = []
    for k in range(1000):
        own = [f"o{k}_{i}" for i in range(48)]
        rows.append((k, " ".join(shared + own)))
        if k % 50 == 0:
            rows.append((2000 + k, " ".join(shared + own[: 10 + k // 200] + [f"n{k}_{i}" for i in range(38 - k // 200)])))
    sets = {k: neardup.shingles(t.encode()) for k, t in rows}
    assert all(0.81 <= neardup.similarity(sets[k], sets[2000 + k]) <= 0.85 for k in range(0, 1000, 50))
    assert max(neardup.similarity(sets[x], sets[y]) for x, y in ((0, 1), (0, 2050), (2000, 2050))) < 0.8
    assert class_of_each(spark, rows) == {k: k % 2000 for k, _ in rows}


def test_no_alike_pair_is_excluded_by_the_bound(spark):
    rng = np.random.default_rng(3)
    texts = {}
    for k in range(80):
        words = [f"w{i}" for i in rng.integers(0, 60, 120)] if k % 8 == 0 else list(words)
        for at in rng.integers(0, len(words), 2 if k % 8 else 0):
            words[at : at + int(rng.integers(0, 3))] = [f"x{rng.integers(0, 9)}"] * int(rng.integers(0, 3))
        texts[k] = " ".join(words)
    sets = {k: neardup.shingles(t.encode()) for k, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "node long, text string").select("node", F.col("node").alias("label"), neardup.squeezed("text").alias("text"))
    for least in (0.5, 0.8):
        found = {(r["a"], r["b"]) for r in neardup.unexcluded(docs, least).collect()}
        alike = {(x, y) for x in sets for y in sets if x < y and neardup.similarity(sets[x], sets[y]) >= least}
        assert len(alike) > 30 and alike <= found and len(found) < 80 * 79 / 4


def test_copies_that_are_alike_only_with_one_that_is_linked_with_the_pivot(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 61):
        at = rng.choice(np.arange(5, 195, 8), 6, replace=False).tolist()
        edited = lambda places: " ".join(f"e{k}_{i}" if i in places else w for i, w in enumerate(base))  # noqa: B023, E731
        rows += [(k, edited(at[:1])), (100 + k, edited(at[:5])), (200 + k, edited(at[5:]))]
    sets = {k: neardup.shingles(t.encode()) for k, t in rows}
    assert all(neardup.similarity(sets[0], sets[k]) > 0.9 and neardup.similarity(sets[0], sets[100 + k]) < 0.78 for k in range(1, 61))
    assert all(neardup.similarity(sets[k], sets[100 + k]) > 0.81 for k in range(1, 61))
    assert class_of_each(spark, rows) == {k: 0 for k, _ in rows}


def test_rows_that_share_an_id_but_not_their_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (1, a), (4, "c d e"), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    found = sorted((r["doc"], r["class_id"]) for r in neardup.near_duplicates(docs).collect())
    assert found == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4)]
    kept = sorted((r["doc_id"], r["text"] or "") for r in neardup.keep_first(docs).collect())
    assert kept == [(1, a), (1, b), (4, ""), (4, ""), (4, "c d e")]
    sets = [neardup.shingles(x.encode()) for x in (a, b)]
    assert neardup.similarity(*sets) == 0


def test_documents_that_each_replace_another_block(spark):
    """150 documents of 400 words with another block of 20 words replaced: over a thousand links, one class."""
    base = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(9)
    rows = []
    for k in range(150):
        at = int(rng.integers(0, 380))
        rows.append((k, " ".join([*base[:at], *(f"x{k}_{i}" for i in range(20)), *base[at + 20 :]])))
    want = brute(dict(rows))
    assert class_of_each(spark, rows) == want


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "start " + long[: len(long) // 2])]
    assert class_of_each(spark, rows) == brute(dict(rows))
