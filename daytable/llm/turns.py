"""Repair of conversations whose turns are out of order, blank, repeated or cut off.

A conversation is in order when the initials of its roles read (s?(ua)+)?. The cheapest edits that lead there are found by
iterative-deepening A*: a depth-first search in the ASCII order of the edits' initials under a bound of cost that rises, so
that the first path accepted is the answer; what a failed place proves about the cost still to come stays in a table.
"""

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytable.llm.common import CRC32, SPACE, cut, in_small_batches, or_empty, small_join, table

#: A row's code is 4 * fault + role.
ROLES = "sua"
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
OTHER = 3
#: Where a conversation stands after a row, and the role that it wants next; BEGUN and ANSWERED may end it.
BEGUN, TOLD, ASKED, ANSWERED = range(4)
ENDS = (BEGUN, ANSWERED)
WANTED = {BEGUN: (1, ASKED), TOLD: (1, ASKED), ASKED: (2, ANSWERED), ANSWERED: (1, ASKED)}
NAMES = {1: "user", 2: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: Rows that one search goes over, and rows and bytes that a task holds before it hands a conversation's piece on.
STRETCH, PIECE_ROWS, PIECE_BYTES = 32, 4096, 8 << 20

Answer = tuple[int, str]


def steps(codes: bytes, at: int, state: int) -> list[tuple[int, str, int, int]]:
    """(cost, initial, next row, next state) of each edit there, in ASCII order of the initials."""
    role, end = WANTED[state]
    out = [(DELETE, "D", at + 1, state)] if at < len(codes) else []
    out.append((INSERT, "I", at, end))
    if at < len(codes) and codes[at] >> 2 < DUPLICATE:
        more, own = CUT_OFF * (codes[at] >> 2 == TRUNCATED), codes[at] & 3
        if own == role:
            out.append((more, "K", at + 1, end))
        else:
            if own == 0 and state == BEGUN:
                out.append((more, "K", at + 1, TOLD))
            out.append((REROLE + more, "R", at + 1, end))
    return out


def searched(codes: bytes, begin: int, ends: tuple[int, ...], least: dict[tuple[int, int], int]) -> Answer | None:
    """(least cost, ASCII-least initials of edits at that cost) from state `begin` to one of `ends`; None where none leads there.
    `least` is the table of places that failed: what the rest up to these ends costs at least, wherever a search began."""
    if not any(e in (ASKED, ANSWERED) or e == begin or (e, begin) == (TOLD, BEGUN) and any(c & 3 == 0 and c >> 2 < DUPLICATE for c in codes) for e in ends):
        return None
    n, rest = len(codes), [0] * (len(codes) + 1)
    for k in range(n - 1, -1, -1):
        fault, role = codes[k] >> 2, codes[k] & 3
        rest[k] = rest[k + 1] + (DELETE if fault >= DUPLICATE or fault and role == OTHER else CUT_OFF if fault else REROLE if role == OTHER else 0)
    known = lambda at, state: least.get((at, state), rest[at])
    while True:
        bound = known(0, begin)
        path: list[str] = []
        stack = [(0, begin, bound, iter(steps(codes, 0, begin)))]
        if not n and begin in ends:
            return 0, ""
        while stack:
            at, state, left, more = stack[-1]
            for cost, initial, to, end in more:
                if cost + known(to, end) <= left:
                    path.append(initial)
                    if to == n and end in ends:
                        return bound - left + cost, "".join(path)
                    stack.append((to, end, left - cost, iter(steps(codes, to, end))))
                    break
            else:
                least[at, state] = max(left + 1, min(cost + known(to, end) for cost, _, to, end in steps(codes, at, state)))
                stack.pop()
                if path:
                    path.pop()


def ways(codes: bytes) -> dict[tuple[int, int], Answer]:
    """The answer between each two states of a stretch of rows, in which they are searched for STRETCH by STRETCH."""
    out = {(b, b): (0, "") for b in WANTED}
    for k in range(0, len(codes), STRETCH):
        part = codes[k : k + STRETCH]
        tables: dict[int, dict] = {e: {} for e in WANTED}
        out = joined(out, {(b, e): a for b in WANTED for e in WANTED if (a := searched(part, b, (e,), tables[e]))})
    return out


def joined(one: dict, two: dict) -> dict[tuple[int, int], Answer]:
    """The answers of two stretches together. Of two answers with one cost neither begins with the other, as edits that were
    over would be insertions, which cost; so the least initials of the whole begin with least ones."""
    out: dict[tuple[int, int], Answer] = {}
    for (b, m), (cost, audit) in one.items():
        for e in WANTED:
            if (m, e) in two:
                found = cost + two[m, e][0], audit + two[m, e][1]
                out[b, e] = min(found, out.get((b, e), found))
    return out


def answer(codes: bytes) -> Answer:
    """The answer for a whole conversation."""
    if len(codes) <= STRETCH:
        return searched(codes, BEGUN, ENDS, {})
    all_ways = ways(codes)
    return min(all_ways[BEGUN, e] for e in ENDS if (BEGUN, e) in all_ways)


def walked(codes: bytes, lines: list[bytes], audit: str, state: int = BEGUN) -> tuple[list[bytes], int]:
    """(the lines that edits leave, the state after them); each line comes with the bytes of its role before it, in four bytes."""
    out, at = [], 0
    for initial in audit:
        role, end = WANTED[state]
        if initial == "I":
            out.append(f"{NAMES[role]}:".encode())
        else:
            if initial == "K":
                out.append(lines[at][4:])
                end = TOLD if codes[at] & 3 == 0 else end
            elif initial == "R":
                out.append(NAMES[role].encode() + lines[at][4 + int.from_bytes(lines[at][:4]) :])
            at += 1
        state = state if initial == "D" else end
    return out, state


def faults(codes: bytes) -> dict[str, int]:
    n = {name: sum(codes.count(4 * fault + r) for r in range(4)) for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    return n | {"illegal": sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))}


REPORT = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string()}
REPORT_SQL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
#: A whole conversation has its report and what is left of it; a piece of one its codes, answers and lines.
PIECE = pa.schema([("conv", pa.int64()), ("whole", pa.bool_()), *REPORT.items(), ("repaired", pa.binary()), ("task", pa.int32()), ("piece", pa.int32()), ("codes", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("lines", pa.list_(pa.binary()))])
PIECE_SQL = f"conv long, whole boolean, {REPORT_SQL}, repaired binary, task int, piece int, codes binary, low long, high long, turns long, costs array<long>, audits array<string>, lines array<binary>"


ROW = ("conv", "turn", "code", "extra", "again", "named", "line")


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _held(codes: bytearray, lines: list[bytes], turns: list) -> dict:
    """What a piece says of its rows: turns come in order, nulls first."""
    known = [t for t in turns if t is not None]
    return {"codes": bytes(codes), "low": known[0] if known else None, "high": known[-1] if known else None, "turns": sum(1 for _ in groupby(known)), "lines": lines}


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWs in order of conversation and turn, as whole conversations where they begin and end in the task and are short, and
    as pieces else. One is there 1 + extra times, the extra ones with code `again`."""
    task, out = TaskContext.get().partitionId(), []
    state = {"conv": None, "piece": 0, "split": False, "edge": True, "any": False, "held": 0}
    codes, lines, turns = bytearray(), [], []
    size = 0

    def closed(last: bool) -> None:
        nonlocal codes, lines, turns, size
        held = _held(codes, lines, turns)
        if last and not state["edge"] and not state["split"]:
            cost, audit = answer(held["codes"])
            gaps = held["high"] - held["low"] + 1 - held["turns"] if held["turns"] else 0
            left = b"\n".join(walked(held["codes"], lines, audit)[0])
            out.append({"conv": state["conv"], "whole": True, "gaps": gaps, **faults(held["codes"]), "cost": cost, "audit": audit, "repaired": left})
        elif codes:
            found = ways(held["codes"])
            pairs = [found.get((b, e)) for b in WANTED for e in WANTED]
            out.append({"conv": state["conv"], "whole": False, "task": task, "piece": state["piece"], "costs": [p and p[0] for p in pairs], "audits": [p and p[1] for p in pairs], **held})
            state["piece"] += 1
            state["split"] = True
        state["held"] += size
        codes, lines, turns, size = bytearray(), [], [], 0

    for batch in batches:
        for conv, turn, code, extra, again, named, line in zip(*(batch.column(c).cast(pa.binary()).to_pylist() if c == "line" else batch.column(c).to_pylist() for c in ROW), strict=True):
            line = named.to_bytes(4) + line
            if not state["any"]:
                state["conv"], state["any"] = conv, True
            elif conv != state["conv"]:
                closed(True)  # the task's first conversation may have begun in another task
                state.update(conv=conv, split=False, edge=False)
            turns.append(turn)
            for k in range(1 + extra):
                codes.append(again if k else code)
                lines.append(line)
                size += len(line)
                if len(codes) >= PIECE_ROWS or size >= PIECE_BYTES:
                    closed(False)
                    turns.append(turn)
            if len(out) >= 1000 or state["held"] >= PIECE_BYTES:
                yield _batch(out, PIECE)
                out, state["held"] = [], 0
    state["edge"] = True  # and its last one may go on in another
    closed(False)
    if out:
        yield _batch(out, PIECE)


ROUTE = f"task int, piece int, state int, edits string, last boolean, {REPORT_SQL}"


def routed(conversation: pa.Table) -> pa.Table:
    """For each piece of a conversation the edits that are its share of the whole's, and with the last one the report."""
    rows = sorted(conversation.to_pylist(), key=lambda r: (r["task"], r["piece"]))
    best: dict[int, tuple[int, str, list]] = {BEGUN: (0, "", [])}
    for r in rows:
        new: dict[int, tuple[int, str, list]] = {}
        for b, (cost, audit, parts) in best.items():
            for e in WANTED:
                if (own := r["costs"][4 * b + e]) is not None:
                    edits = r["audits"][4 * b + e]
                    found = cost + own, audit + edits, [*parts, (b, edits)]
                    new[e] = min(new.get(e, found), found)
        best = new
    cost, audit, parts = min(best[e] for e in ENDS if e in best)
    count = {n: 0 for n in ("blank", "duplicate", "truncated", "illegal")}
    turns, high, before = 0, None, b""
    for r in rows:
        for n, x in faults(before[-1:] + r["codes"]).items():
            count[n] += x
        for n, x in faults(before[-1:]).items():
            count[n] -= x
        turns += r["turns"] - (r["turns"] > 0 and r["low"] == high)
        high, before = (r["high"] if r["turns"] else high), r["codes"]
    low = next((r["low"] for r in rows if r["turns"]), None)
    report = {"gaps": high - low + 1 - turns if turns else 0, **count, "cost": cost, "audit": audit}
    out = [{"task": r["task"], "piece": r["piece"], "state": b, "edits": edits, "last": r is rows[-1], **(report if r is rows[-1] else {})} for r, (b, edits) in zip(rows, parts, strict=True)]
    return pa.Table.from_pylist(out, pa.schema([("task", pa.int32()), ("piece", pa.int32()), ("state", pa.int32()), ("edits", pa.string()), ("last", pa.bool_()), *REPORT.items()]))


def repaired_pieces(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", extra: Column | None = None) -> DataFrame:
    """(conv, task, piece, last, whole, repaired, gaps, blank, duplicate, truncated, illegal, cost, audit): each conversation's rows
    as `role:text` lines after the cheapest edits, joined by \\n, mostly in one piece, that of a long one in pieces, in order of
    task and piece; the last piece has the report. `extra`: how many more times a row is there, adjacent.

    Rows of a conversation come by turn (nulls first), those of one turn in an order by hash of their role and text. Null roles
    and texts are one space; a null conversation is one like any other. A row is blank without a character that is not white
    space, duplicate where its role and text came earlier, truncated where the last such character is no [.!?]: its first
    fault counts. Kept as it is it costs 0, with the role changed 3, deleted 4; blank and duplicate ones go; an empty row put
    in costs 3; a truncated one that stays 3 more. gaps are turns missing between the first and the last, illegal are
    neighbours whose initials are not su, ua or au. A role that begins with another letter, or is empty, has to be changed.
    An empty table gives an empty table; columns beside the four are left out.

    Equal rows are counted before they move. Rows are then dealt out by ranges of conversation and turn, so that a conversation
    that holds a third of all rows is the work of many tasks. Each searches its own piece, from each state to each; what meets
    per conversation is these answers, as long as the audit that is asked for. Texts move twice, those of pieces once more.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    said = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), value(role).alias("role"), value(text).alias("text"), (F.lit(1) if extra is None else extra + 1).cast("long").alias("n"))
    key = [F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)]
    said = said.select("*", *key)
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    of = said.groupBy("conv", "h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    again = cut(of.filter("first <> last").select("conv", "h1", "h2", "first"))  # role and text at several turns
    once = said.groupBy("conv", "turn", "h1", "h2").agg(F.sum("n").alias("n"), F.first("role").alias("role"), F.first("text").alias("text"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in ("conv", "h1", "h2")]
    met = small_join(once, again.select(*(F.col(c).alias(f"of_{c}") for c in ("conv", "h1", "h2")), "first"), same[0] & same[1] & same[2], "left")
    trimmed = F.btrim("text", F.lit(SPACE))
    blank, later = trimmed == "", F.coalesce(order != F.col("first"), F.lit(False))
    fault = F.when(blank, BLANK).when(later, DUPLICATE).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    initial = F.substring("role", 1, 1)
    who = F.when(initial == ROLES[0], 0).when(initial == ROLES[1], 1).when(initial == ROLES[2], 2).otherwise(OTHER)
    coded = met.select("conv", "turn", "h1", "h2", (4 * fault + who).cast("int").alias("code"), (F.col("n") - 1).alias("extra"), (4 * F.when(blank, BLANK).otherwise(DUPLICATE) + who).cast("int").alias("again"), F.octet_length("role").alias("named"), F.concat("role", F.lit(":"), "text").alias("line"))
    place = ["conv", "turn", "h1", "h2"]  # nulls come first
    dealt = coded.repartitionByRange(*place).sortWithinPartitions(*place).select(*ROW)
    found = cut(dealt.mapInArrow(pieces, PIECE_SQL))
    report = [c.split()[0] for c in REPORT_SQL.split(", ")]
    whole = found.filter("whole").select("conv", "task", "piece", F.lit(True).alias("last"), "whole", "repaired", *report)
    parts = found.filter("not whole")
    routes = cut(parts.select("conv", "task", "piece", "codes", "low", "high", "turns", "costs", "audits").groupBy("conv").applyInArrow(routed, ROUTE))

    def rest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                left = walked(r.pop("codes"), r.pop("lines"), r.pop("edits"), r.pop("state"))[0]
                fields = [("conv", pa.int64()), ("task", pa.int32()), ("piece", pa.int32()), ("last", pa.bool_()), ("whole", pa.bool_()), ("repaired", pa.binary()), *REPORT.items()]
                yield _batch([r | {"whole": False, "repaired": b"\n".join(left) if left else None}], pa.schema(fields))

    joined_parts = parts.select("conv", "task", "piece", "codes", "lines").join(routes, ["task", "piece"])
    return whole.unionByName(joined_parts.mapInArrow(rest, f"conv long, task int, piece int, last boolean, whole boolean, repaired binary, {REPORT_SQL}"))


def hashed(parts: DataFrame) -> DataFrame:
    """(conv, repaired_sha256, report) from repaired_pieces: pieces of a conversation are read in order, one at a time."""
    report = [c.split()[0] for c in REPORT_SQL.split(", ")]
    schema = pa.schema([("conv", pa.int64()), ("repaired_sha256", pa.string()), *REPORT.items()])

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, begun = hashlib.sha256(), False
        for batch in batches:
            for r in batch.to_pylist():
                if r["repaired"] is not None:
                    sha.update((b"\n" if begun else b"") + r["repaired"])
                    begun = True
                if r["last"]:
                    yield _batch([{"conv": r["conv"], "repaired_sha256": sha.hexdigest(), **{n: r[n] for n in report}}], schema)
                    sha, begun = hashlib.sha256(), False

    alone = parts.filter("whole").select("conv", F.sha2("repaired", 256).alias("repaired_sha256"), *report)
    long = parts.filter("not whole").repartition("conv").sortWithinPartitions("conv", "task", "piece")
    return alone.unionByName(long.mapInArrow(stream, f"conv long, repaired_sha256 string, {REPORT_SQL}"))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with some rows dropped, emptied, without [.!?], twice (extra is 1) or by the user, by a CRC of conversation and turn."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(value("text"), ".!?", "")).otherwise(value("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(value("role"))
    return rows.withColumn("kind", kind).filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 3).cast("int").alias("extra"))


def op12_astar_repair(spark, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    rows = table(spark, sf_dir, "conversations")
    found = hashed(repaired_pieces(damaged(rows), extra=F.col("extra")))
    ids = rows.select("conv_id").distinct()
    met = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    number = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *number, or_empty(F.col("audit")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


INS, ADDS = {0: "23", 1: "23", 2: "32", 3: "23"}, {"2": "user", "3": "assistant"}
_PUT = [f"({st}, '{'I' * k}', {(st, *map(int, INS[st]))[k]}, {3 * k}, '{''.join(f'|{ADDS[x]}:' for x in INS[st][:k])}')" for st in INS for k in range(3)]
_EDIT = [*(f"({st}, 'D', NULL, {st}, 4, NULL)" for st in range(4)), "(0, 'K', 's', 1, 0, NULL)", *(f"({st}, 'K', '{'a' if st == 2 else 'u'}', {3 if st == 2 else 2}, 0, NULL)" for st in range(4)),
         *(f"({st}, 'R', NULL, {3 if st == 2 else 2}, 3, '{'assistant' if st == 2 else 'user'}')" for st in range(4))]
OP12_SQL = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT *, {CRC32.format("name")} % 20 AS h FROM k),
r AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM r),
f AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut, role[1] AS c, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM o),
rows AS (SELECT *, blank OR again AS goes FROM f),
put(st, ins, st1, c, lines) AS (VALUES {", ".join(_PUT)}),
edit(st1, e, own, st2, c, role) AS (VALUES {", ".join(_EDIT)}),
d AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS st, 0 AS cost, '' AS audit, '' AS kept FROM rows GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, st, w.cost, w.audit, w.kept FROM (
    SELECT conv_id, i, st2 AS st, min({{'cost': cost, 'audit': audit, 'kept': kept}}) AS w FROM (
      SELECT d.conv_id, rows.i, edit.st2, d.cost + put.c + edit.c + CASE WHEN edit.e <> 'D' AND rows.cut THEN 3 ELSE 0 END AS cost, d.audit || put.ins || edit.e AS audit,
        d.kept || replace(put.lines, '|', chr(10)) || CASE WHEN edit.e = 'D' THEN '' ELSE chr(10) || coalesce(edit.role, rows.role) || ':' || rows.text END AS kept
      FROM d JOIN rows ON rows.conv_id IS NOT DISTINCT FROM d.conv_id AND rows.i = d.i + 1 JOIN put ON put.st = d.st JOIN edit ON edit.st1 = put.st1 AND (edit.own IS NULL OR edit.own = rows.c) AND (edit.e = 'D' OR NOT rows.goes))
    GROUP BY conv_id, i, st2)),
n AS (SELECT conv_id, max(i) AS n, (max(turn) - min(turn) + 1 - count(DISTINCT turn)) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (cut AND NOT goes) AS truncated, count(*) FILTER (b IS NOT NULL AND b || c NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
z AS (SELECT d.conv_id, min({{'cost': d.cost + put.c, 'audit': d.audit || put.ins, 'kept': d.kept || replace(put.lines, '|', chr(10))}}) AS w
  FROM d JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND n.n = d.i JOIN put ON put.st = d.st WHERE put.st1 IN (0, 3) GROUP BY d.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(z.w.cost, 0)::BIGINT AS cost, coalesce(z.w.audit, '') AS audit, sha256(coalesce(substr(z.w.kept, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""
