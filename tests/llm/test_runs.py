import hashlib
import random
import zlib

from pyspark.sql import functions as F

from daytable.llm import runs


def brute(words, least=12):
    """Each period's stretches of equal words, by comparing word by word."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q - s), q)
            i += i == s
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5 and words:
            a = rng.randrange(len(words))
            p = 1 + rng.randrange(max(1, (len(words) - a) // 2))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        least = rng.choice([12, 12, 2, 5])
        assert runs.runs_of(words, least) == brute(words, least), words


def test_long_texts_of_few_words_and_of_many_like_places_take_no_square_time():
    one, two = [b"a"], [b"a", b"b"]
    while len(two) < 20_000:
        one, two = two, two + one
    assert len(runs.runs_of(two)) > 5000
    assert runs.runs_of([b"a"] * 20_000) == [(0, 20_000, 1)]
    assert runs.runs_of([w for k in range(2500) for w in (b"l%d" % k, *(b"x%d" % j for j in range(7)))]) == []


def test_rows_come_back_with_their_columns(spark):
    rows = [(1, "a b " * 10, 5), (1, "a b " * 10, 5), (2, None, 6), (None, "", 7), (3, "x " * 100_000 + "end", 8), (4, " one\x1ctwo\tthree\n", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    found = runs.periodic_runs(docs)
    assert found.columns == [*docs.columns, "runs"]
    got = {(r["doc_id"], r["n_words"]): r["runs"] for r in found.collect()}
    assert found.count() == len(rows)
    assert [tuple(r) for r in got[1, 5]["runs"]] == [(0, 20, 2)] and got[1, 5]["kept"] == "a b"
    assert got[2, 6]["kept"] == got[None, 7]["kept"] == "" and got[2, 6]["runs"] == [] and got[2, 6]["n_words"] == 0
    assert [tuple(r) for r in got[3, 8]["runs"]] == [(0, 100_000, 1)] and got[3, 8]["kept"] == "x end"
    assert got[4, 9]["kept"] == "one\x1ctwo three"
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(b"a\xff b",)], "text binary").select(F.col("text").cast("string"))
    assert runs.periodic_runs(odd).select(F.hex("runs.kept")).first()[0] == "61FF2062"


def test_every_tenth_document_repeats_words(spark):
    texts = {k: " ".join(f"w{j}" for j in range(3 + k % 50)) for k in range(200)}
    docs = spark.createDataFrame([*texts.items(), (None, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in docs.select("doc_id", runs.with_periods(F.col("text"), F.col("doc_id")).alias("text")).collect()}
    hit = 0
    for k, t in texts.items():
        h, words = zlib.crc32(str(k).encode()), t.split()
        if h % 10 == 0:
            hit += 1
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
        assert got[k] == " ".join(words)
    assert hit > 5 and got[None] == "a b"


def test_digests_follow_from_the_runs(spark, tmp_path):
    text = "start " + "p q r " * 8 + "then s s s s s s s s s s s s s end"
    spark.createDataFrame([(k, text) for k in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in runs.op11_periodic_runs(spark, str(tmp_path)).collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 10:
            want = brute(text.split())
            assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (2, 1, 24, 3, 8000)
            assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
            assert r["collapsed_sha256"] == hashlib.sha256(b"start p q r then s end").hexdigest()
