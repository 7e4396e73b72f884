import random
import re

import numpy as np
from pyspark.sql import functions as F

from daytable.llm import substrings


def brute(docs: list[tuple], window: int = 13) -> list[tuple]:
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first: dict[tuple, int] = {}
    for d, ws in words:
        for i in range(len(ws) - window + 1):
            if d is not None:
                k = tuple(ws[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, ws in words:
        gone = {i + j for i in range(len(ws) - window + 1) if d is not None and first[tuple(ws[i : i + window])] < d for j in range(window)}
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=repr)


def test_random_documents_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 4000)  # many chunks and buckets
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 6000)
    monkeypatch.setattr(substrings, "ROW_BYTES", 1)
    rng = random.Random(6)
    passages = [[f"p{k}w{i % 17}" for i in range(rng.randint(10, 60))] for k in range(6)]
    docs = []
    for k in range(150):
        ws = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            ws += p[a:] if rng.random() < 0.5 else p[: a + 13]
            ws += [f"u{rng.randint(0, 400)}" for _ in range(rng.randint(0, 8))]
        docs.append((k * 7 % 151 if k % 11 else None, rng.choice([" ", "\n", " x\t"]).join(ws)))
    docs += [(500, None), (501, ""), docs[1], docs[1], (docs[2][0], docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("chunk", F.lit("clash"))
    found = sorted((tuple(r) for r in substrings.repeats(df).collect()), key=repr)
    assert found == brute(docs)
    assert sum(r[2] for r in found) > 1000


def test_short_windows_and_empty_table(spark):
    docs = [(1, "a b c d"), (2, "x a b c y a b"), (3, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in substrings.repeats(df, window=2).collect()), key=repr) == brute(docs, 2)
    assert substrings.repeats(df.limit(0)).count() == 0


def test_all_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in substrings.repeats(df).collect()), key=repr) == brute(docs)


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = [f"w{rng.randint(0, 90_000)}" for _ in range(150_000)]
    docs = [(1, " ".join(long)), (2, " ".join([*long[50_000:120_000], "end"])), (3, " ".join(long[:40])), (4, "x" * 3_000_000)]
    found = sorted((tuple(r) for r in substrings.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    assert found == brute(docs)
    assert found[1][2] == 70_000


def test_steps_give_back_the_numbers():
    for x in ([5], [0, 0, 3], [-(1 << 63), -7, 0, 300, (1 << 63) - 1], list(range(0, 70_000 * 5, 70_000))):
        x = np.array(x, np.int64)
        assert (substrings.from_steps(substrings.ascending(x)) == x).all()


def test_ids_from_end_to_end(spark):
    same = " ".join(f"w{k}" for k in range(30))
    docs = [((1 << 63) - 1, same), (-(1 << 63), same + " x"), (0, "y " + same), (-5, same), (3, same)]
    assert sorted((tuple(r) for r in substrings.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr) == brute(docs)
