import hashlib
import random
import re

from pyspark.sql import functions as F

from daytable.llm import sketches

SPACE = " \t\n\x0b\x0c\r"


def paragraphs(text):
    cut = [x for line in text.split("\n") for x in ([line] if len(line) <= sketches.LONG else re.split("[.!?]+", line))]
    return {int(hashlib.md5(x.strip(SPACE).encode()).hexdigest()[:15], 16) for x in cut if x.strip(SPACE)}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_differences_are_recovered_with_their_signs(spark):
    rng = random.Random(3)
    some = lambda n: [rng.randrange(1 << 60) for _ in range(n)]
    rows = []
    for n in [*range(0, 30), 100, 1000, 3000]:
        both, left, right = some(n), some(rng.randint(0, n)), some(rng.randint(0, 5))
        rows.append((n, both + left, right + both, left, right))
    df = spark.createDataFrame(rows, "n int, a array<long>, b array<long>, left array<long>, right array<long>")
    for r in df.select("*", sketches.differences(sketches.parts(F.col("a"), F.col("b"))).alias("found")).collect():
        assert sorted(e["d"] for e in r["found"] if e["n"] == 1) == sorted(r["left"]), r["n"]
        assert sorted(e["d"] for e in r["found"] if e["n"] == -1) == sorted(r["right"]), r["n"]


def test_a_table_that_stays_full_is_tried_again_with_more_cells(spark, monkeypatch):
    monkeypatch.setattr(sketches, "CELLS", 1)
    df = spark.createDataFrame([([k * 7919 << 20 | k for k in range(1, 6)], [1 << 59])], "a array<long>, b array<long>")
    row = df.select(sketches.is_empty(sketches.peeled(sketches.minus(sketches.sketch(F.col("a"), 1), sketches.sketch(F.col("b"), 1)), 1)).alias("ok"), sketches.differences(sketches.parts(F.col("a"), F.col("b"))).alias("found")).first()
    assert not row["ok"] and len(row["found"]) == 6


def test_documents_against_plain_python(spark):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", "!"])
    texts = ["\n".join(line() for _ in range(rng.randint(0, 12))) for _ in range(60)] + [" ".join(line() for _ in range(400)), "é\n" * 7, None, "", " \n\t"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, "other"), (None, texts[0])]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_chars int, edited string")
    got = sketches.compared(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc"], []).append(r)
    order = sorted({k for k, _ in rows if k is not None}, reverse=True) + [None]
    for k, follower in zip(order, [*order[1:], order[0]], strict=True):
        if k in (3, 4) or follower in (3,):
            continue
        mine, ahead = (next(t or "" for i, t in rows if i == x) for x in (k, follower))
        half = len(mine) // 2
        edited = mine[: len(mine) - half] + ahead[:half]
        (r,) = by[k]
        assert (r["n_chars"], r["edited"]) == (len(mine), edited)
        assert abs(r["near_edited"] - alike(paragraphs(mine), paragraphs(edited))) < 1e-12
        assert abs(r["near_next"] - alike(paragraphs(mine), paragraphs(ahead))) < 1e-12
    prints = {}
    for r in got:
        prints.setdefault((r["doc"], r["n_chars"]), set()).add((r["fingerprint"], r["edited"]))
    assert all(len(p) == 1 for p in prints.values())  # rows that are equal come back alike
    assert by[None][0]["fingerprint"] == by[0][0]["fingerprint"]
    assert len(by[3]) == 3


def test_one_document_follows_itself_and_none_gives_none(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd")], "doc_id long, text string")
    (r,) = sketches.compared(docs).collect()
    assert r["edited"] == "a\nb\na\nb" and r["near_next"] == 1.0 and r["near_edited"] == 0.5
    assert sketches.compared(docs.limit(0)).count() == 0
    assert sketches.fingerprints(docs.withColumn("fingerprint", F.lit(1))).columns == ["doc_id", "text", "fingerprint"]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert "Python" not in sketches.compared(docs)._jdf.queryExecution().executedPlan().toString()
