import hashlib
import heapq
import random
import re
import zlib

import pytest

from daytable.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(codes, begin=0, ends=(0, 3)):
    """The least (cost, initials), by a search that knows no bounds."""
    heap, seen = [(0, "", 0, begin)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(codes) and state in ends:
            return cost, audit
        if (at, state) not in seen:
            seen.add((at, state))
            for more, initial, to, end in turns.steps(codes, at, state):
                heapq.heappush(heap, (cost + more, audit + initial, to, end))


def some_codes(rng, most):
    return bytes(4 * rng.choice([0, 0, 0, 0, 1, 2, 3]) + rng.choice([0, 1, 2, 1, 2, 3]) for _ in range(rng.randint(0, most)))


def test_searches_against_dijkstra(monkeypatch):
    rng = random.Random(2)
    for _ in range(800):
        codes = some_codes(rng, 12)
        assert turns.answer(codes) == cheapest(codes)
        assert re.fullmatch("(s?(ua)+)?", "".join("sua"[c & 3] for c in edited(codes, turns.answer(codes)[1])))
        for begin in range(4):
            for end in (2, 3, begin):
                assert turns.searched(codes, begin, (end,), {}) == cheapest(codes, begin, (end,))
            assert turns.searched(codes, 3, (1,), {}) is None
    monkeypatch.setattr(turns, "STRETCH", 3)
    for _ in range(500):
        codes = some_codes(rng, 20)
        assert turns.answer(codes) == cheapest(codes)


def edited(codes, audit):
    state, at = 0, 0
    for x in audit:
        role, end = turns.WANTED[state]
        if x in "IR":
            yield role
        if x == "K":
            yield codes[at] & 3
            end = 1 if codes[at] & 3 == 0 else end
        at += x != "I"
        state = state if x == "D" else end


def plain(rows):
    """The query's rows, from the whole table in plain Python. Rows of one turn are equal here."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            mine += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        codes, seen, count = [], set(), [0, 0, 0, 0]
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 3 if not body else 2 if (role, text) in seen else 1 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            count[fault] += 1
            codes.append(4 * fault + ("sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3))
        known = {t for t, _, _ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit = cheapest(bytes(codes))
        lines, state, at = [], 0, 0
        for x in audit:
            role, end = turns.WANTED[state]
            if x == "I":
                lines.append(turns.NAMES[role] + ":")
            else:
                _, own, text = mine[at]
                if x != "D":
                    lines.append(f"{own if x == 'K' else turns.NAMES[role]}:{text}")
                    end = 1 if x == "K" and own[0] == "s" else end
                at += 1
            state = state if x == "D" else end
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, count[3], count[2], count[1], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(rng, convs, most):
    rows = []
    for conv in convs:
        for turn in [*range(rng.randint(1, most)), *([None] if rng.random() < 0.2 else [])]:
            if rng.random() < 0.9:
                role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "a:b"]) if rng.random() < 0.4 else ("user", "assistant")[(turn or 0) % 2]
                rows += [(conv, turn, role, rng.choice(["Yes.", "No!\n", "é?\t", "so", " ", "", None, "x: y.", f"{turn} is it."]))] * rng.choice([1, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize(("convs", "most", "piece"), [([*range(60), None], 8, 4096), ([7], 300, 20), ([1, 2, None, 3], 60, 7)])
def test_query_against_plain_python(spark, tmp_path, monkeypatch, convs, most, piece):
    monkeypatch.setattr(turns, "PIECE_ROWS", piece)
    rows = table(random.Random(most), convs, most)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r[0]: tuple(r)[1:] for r in turns.op12_astar_repair(spark, str(tmp_path)).collect()}
    assert found == plain(rows)


def test_a_row_repeated_very_often_is_one_row_until_it_is_written(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hm."), (1, 1, "assistant", "Oh.")], SCHEMA).selectExpr("*", "explode(sequence(1, if(turn = 0, 20000, 1)))").drop("col")
    parts = turns.repaired_pieces(rows).collect()
    last = next(r for r in parts if r["last"])
    assert (last["duplicate"], last["cost"], last["gaps"]) == (19_999, 4 * 19_999, 0)
    assert last["audit"] == "K" + "D" * 19_999 + "K"
    parts = sorted((r for r in parts if r["repaired"] is not None), key=lambda r: (r["task"], r["piece"]))
    assert b"\n".join(bytes(r["repaired"]) for r in parts) == b"user:Hm.\nassistant:Oh."


def test_no_rows_clashing_columns_and_conversations_that_lose_all(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA + ", conv int, audit string, n int, h1 int")
    assert turns.repaired_pieces(none).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "Hm.", 5, "x", 6, 7), (1, 1, "assistant", "Oh", 5, "x", 6, 7)], none.schema)
    assert [(r["cost"], r["audit"], r["truncated"]) for r in turns.repaired_pieces(odd).collect() if r["last"]] == [(3, "KK", 1)]
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hm.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in turns.op12_astar_repair(spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
