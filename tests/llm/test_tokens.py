import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daytable.llm import bpe, counts, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = " \n\t 　abcXYZ'sdé12 !?<|>\x1c\x85日本́🙂"


def texts() -> list[str]:
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["a<|endoftext|> b", "", "  ", "it's  we'll\n\n x", "y" * 5000]


def test_ids_are_those_of_the_tokenizers_library():
    real, mine = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    for t, ids in zip(texts(), mine.encode(texts()), strict=True):
        assert ids.tolist() == real.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_hold_each_id_once_and_sequences_are_full(spark):
    real = Tokenizer.from_file(PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = packing.op8_slack_packing(spark, "/root/testdata/sf0.01").collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == docs.keys()
    for d, parts in by_doc.items():
        ids = np.array([*real.encode(docs[d], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.01 * math.ceil(total / 1024)


def test_packing_of_nulls_empty_texts_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "same"), (3, "same")], "doc_id long, text string").withColumn("length", F.lit("x"))
    rows = packing.pack(docs).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == [("1", 1), ("2", 1), ("3", 2), ("3", 2), ("None", 3)]
    assert {r["sequence_id"] for r in rows} == {0}
    assert sorted(r["offset"] for r in rows) == sorted(np.cumsum([0, *sorted((r["length"] for r in rows), reverse=True)])[:-1].tolist())
    assert packing.pack(docs.limit(0)).count() == 0


def test_fill_comes_closest_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        have = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 30)
        sums = {0}
        for n, c in have.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        chosen = packing.fill(have, room)
        assert all(c <= have[n] for n, c in chosen.items())
        assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= room)


def greedy(word: bytes, pieces: set[bytes]) -> int:
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


def test_automaton_against_greedy_matching():
    rng = random.Random(4)
    for _ in range(150):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 14))) for _ in range(60)]
        assert counts.Automaton(sorted(pieces)).lengths(words).tolist() == [greedy(w, pieces) for w in words]


def test_counts_of_all_documents(spark):
    pieces = set(bpe.byte_pieces(PATH))
    known: dict[bytes, int] = {}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = counts.op7_longest_match_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = docs[r["doc_id"]].encode().split()
        for w in words:
            if w not in known:
                known[w] = greedy(b" " + w, pieces)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))


def test_counts_of_nulls_empty_and_long_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, " \n"), (3, "z" * 300_000), (3, "z" * 300_000)], "doc_id long, text string").withColumn("tokens", F.lit(1))
    found = {r["doc_id"]: (r["tokens"]["n_words"], r["tokens"]["n_tokens"]) for r in counts.count_tokens(docs).collect()}
    assert found[1] == found[2] == (0, 0)
    longest = max(len(p) for p in bpe.byte_pieces(PATH))
    assert found[3][0] == 1 and 300_000 / longest < found[3][1] < 300_000
    assert counts.count_tokens(docs.limit(0)).count() == 0


def test_very_long_texts_are_packed_whole(spark):
    long = " ".join(f"w{k % 997}" for k in range(400_000)) + "x" * 300_000
    rows = packing.pack(spark.createDataFrame([(1, long), (2, "a b")], "doc_id long, text string")).collect()
    ids = np.array([*Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids, 0], "<u4")
    mine = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["start"])
    assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)


def test_another_kind_of_tokenizer_file_gives_its_own_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    real, mine = Tokenizer.from_file(path), bpe.Encoder(path)
    some = ["It's  A Test of  WORDS, 123", "", "café 日本"]
    assert not mine.quick and bpe.Encoder(PATH).quick
    for t, ids in zip(some, mine.encode(some), strict=True):
        assert ids.tolist() == real.encode(t, add_special_tokens=False).ids
