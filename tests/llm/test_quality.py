import random
import re
from collections import Counter

from pyspark.sql import functions as F

from daytable.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str) -> tuple:
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines)


def test_measures_against_brute_force():
    rng = random.Random(5)
    for n in range(300):
        text = "".join(rng.choice(["a ", "b ", "é ", "#", "<x> ", "\n", "\t", "\x1c", "日 "]) for _ in range(rng.randint(0, 120)))
        assert quality.measure(text.encode()) == brute(text), repr(text)


def test_all_rows_come_back_with_their_columns(spark):
    good = "the quick brown fox jumps over a lazy dog and then some more words follow"
    rows = [(1, good, 9), (1, good, 9), (2, None, 8), (None, "", 7), (3, "word " * 40, 6), (4, "x" * 2_000_000 + " " + good, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    kept = quality.ledger(docs)
    assert kept.columns == ["doc_id", "text", "n_words", "ledger"]
    bits = {(r["doc_id"], r["text"]): r["ledger"]["bits"] for r in kept.collect()}
    assert bits[1, good] == 0
    assert bits[2, None] == bits[None, ""] == quality.BITS["few_words"]
    assert bits[3, "word " * 40] == quality.BITS["repeated_words"]
    assert kept.count() == len(rows)
    assert sorted(r["n_words"] for r in quality.reject(docs).collect()) == [5, 9, 9]
    assert quality.reject(docs).columns == docs.columns
    assert quality.ledger(docs.limit(0)).count() == 0


def test_ablations_follow_from_the_bits(spark):
    b = quality.BITS
    masks = [0, b["few_words"], b["few_words"] | b["symbols"], b["symbols"], b["long_words"]]
    df = spark.createDataFrame([(m,) for m in masks], "bits long").select(F.struct("bits").alias("ledger"))
    found = {(r["policy"], r["rule"]): (r["rejected"], r["fails_rule"], r["only_rule"]) for r in quality.ablations(df).collect()}
    assert found["base", "few_words"] == (2, 2, 2)
    assert found["v1", "few_words"] == (3, 2, 1)
    assert found["v1", "symbols"] == (3, 2, 1)
    assert found["v2", "long_words"] == (4, 1, 1)
