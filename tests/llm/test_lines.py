import hashlib
import random
from collections import defaultdict

import tests_support
from pyspark.sql import functions as F

from daytable.llm import lines

WS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs: list[tuple], least: int = 10, min_docs: int = 2) -> list[tuple]:
    key = lambda x: x.strip(WS).translate(LOWER)
    holds = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= least:
                holds[key(x)].add(d)
    out = []
    for d, t in docs:
        ls = (t or "").split("\n")
        stay = [x for x in ls if not (d is not None and len(holds.get(key(x), ())) >= min_docs and min(holds[key(x)]) != d)]
        out.append((d, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["lines"]["n_lines"], r["lines"]["n_dropped"], r["lines"]["kept"]) for r in df.collect()), key=repr)


def test_random_documents_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["short", "  A LINE that is Long ", "a line that is long", "é" * 10, "É" * 10, "", " ten chars x", "unique"]
    docs = [(rng.choice([None, *range(40)]) if k % 9 == 0 else k, "\n".join(rng.choice(pool) + (str(k) if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 9)))) for k in range(120)]
    docs += [(7, None), (8, ""), docs[3], docs[3]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(lines.dedup_lines(df)) == brute(docs)
    assert found(lines.dedup_lines(df, min_docs=5)) == brute(docs, min_docs=5)


def test_long_text_empty_table_and_clashing_columns(spark):
    line = "the very same line"
    docs = [(1, "\n".join(f"line number {k}" for k in range(50_000))), (2, f"line number 77\n{line}"), (3, line)]
    df = spark.createDataFrame([(*d, "kept", 1) for d in docs], "doc_id long, text string, pos string, lines int")
    done = lines.dedup_lines(df)
    assert done.columns == ["doc_id", "text", "pos", "lines"]
    assert found(done) == brute(docs)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_query_digest(spark):
    row = lines.op5_line_dedup(spark, "/root/testdata/sf0.001").filter("n_dropped = 0").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id = {row['doc_id']}").first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_the_places_of_a_hot_line_are_split(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one very common line\nand another "), F.when(F.col("id") % 3 > 0, "x").otherwise(F.col("id").cast("string"))).alias("text"))
    places, found = lines.find_lines(docs, "doc_id", "text", 10, 2)
    plan = tests_support.final_plan(lines.lost_places(places, lines.cut(found)))
    assert "skew=true" in plan
