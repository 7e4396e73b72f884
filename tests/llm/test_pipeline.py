from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests_support import brute_lines, brute_near, levels
from tokenizers import Tokenizer

import corpus_pipeline as p
from daytable.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        out.append(docs)
    return out


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_each_stage_against_brute_force(stages):
    rows = [df.collect() for df in stages]
    passed = [r for r in rows[0] if quality.measure(r["text"].encode())[0] >= 10]
    assert {r["doc_id"] for r in rows[1]} <= {r["doc_id"] for r in passed}
    assert len(rows[1]) > 0.5 * len(rows[0])
    want = {d: kept for d, _, _, kept in brute_lines([(r["doc_id"], r["text"]) for r in rows[1]])}
    assert {r["doc_id"]: r["text"] for r in rows[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2] if r["text"] != next(x["text"] for x in rows[1] if x["doc_id"] == r["doc_id"]))
    classes = brute_near({r["doc_id"]: r["text"] for r in rows[2]})
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(d for d, c in classes.items() if d == c)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows[3]:
        n = len(r["text"].encode().split())
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in rows[4]:
        taken[r["source"]] += len(r["text"].encode().split())
    for s, t in levels(sizes).items():
        assert abs(taken[s] - t) <= 1.05 * largest[s] + 1
    assert max(Counter(r["doc_id"] for r in rows[4]).values()) <= 2
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(real.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows[4])
    assert sum(r["length"] for r in rows[5]) == tokens
    used = defaultdict(list)
    for r in rows[5]:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024


def test_run_gives_the_last_stage(spark, stages):
    found = p.run(spark, SF)
    assert found.columns == stages[-1].columns
    assert found.count() == stages[-1].count()


def test_stages_take_no_rows_and_odd_columns(spark, stages):
    docs = spark.createDataFrame([(1, None, "en", "s", 0, "x", 1), (2, "", None, None, None, "y", 2)], "doc_id long, text string, lang string, source string, n_chars long, copies string, target int")
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
