"""Substring dedup on the de Bruijn graph of a corpus.

A window of 13 consecutive words is an edge from its first 12 words to its last 12. Edges meet by their hash at the place
where each occurs first, its source coordinates (document, position). Consecutive edges of a document whose sources are
consecutive too have no branch between them and compact into one path; a path is joined with its source document, where
its words are compared. What reaches the last step is a few paths per document instead of an edge per word.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytable.llm.common import cut, in_small_batches, or_empty, same, small_join, squeezed, table, unsqueezed
from daytable.llm.words import gram_hashes, mixed, word_hashes

WINDOW = 13
#: Text in a chunk, and behind the edges of a bucket, at least; and text behind a row of edges that a chunk has for a bucket.
CHUNK_BYTES, BUCKET_BYTES, ROW_BYTES = 4 << 20, 4 << 20, 256
KEY = np.uint64((1 << 56) - 1)
ASK = "bucket int, chunk int, docs binary, counts binary, steps binary, keys binary"
ANSWER = "chunk int, bucket int, at binary, home_chunk binary, home_doc binary, home_start binary"
PATH = "chunk int, row int, start int, words int, home_chunk int, home_doc long, home_start int, digest binary"
HOME = ["home_chunk", "home_doc", "home_start", "words", "digest"]


class Chunk:
    """The documents of one chunk, in a fixed order, with their edges."""

    def __init__(self, rows: pa.Table, window: int, edges: bool = True):
        pairs = zip(rows["doc"].to_pylist(), map(unsqueezed, rows["body"].to_pylist()), rows["copies"].to_pylist(), strict=True)
        self.window = window
        ordered = sorted(pairs, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.ids = [d for d, _, _ in ordered]
        self.words = [t.split() for _, t, _ in ordered]
        self.copies = [n for _, _, n in ordered]
        if not edges:
            return
        hashes, owner, start = [], [], []
        for k, (d, words) in enumerate(zip(self.ids, self.words, strict=True)):
            if d is not None and len(words) >= window:
                h = gram_hashes(word_hashes(words), window)
                hashes.append(h)
                owner.append(np.full(len(h), k, np.int32))
                start.append(np.arange(len(h), dtype=np.int32))
        none = [np.zeros(0, np.int32)]
        h = np.concatenate(hashes + [np.zeros(0, np.uint64)])
        self.owner, self.start = np.concatenate(owner + none), np.concatenate(start + none)
        self.doc = np.array([0 if d is None else d for d in self.ids], np.int64)[self.owner]
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))[: len(h)]
        group = np.cumsum(new) - 1
        first = order[new]  # of each distinct edge, where the chunk has it first
        self.first = np.empty(len(h), np.int64)
        self.first[order] = first[group] if len(h) else first
        self.h = h
        self.firsts = np.sort(first)

    def by_bucket(self, buckets: int):
        """(bucket, the first occurrences of its edges in order of document and position)."""
        bucket = (mixed(self.h[self.firsts]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            if ends[b] < ends[b + 1]:
                yield b, self.firsts[order[ends[b] : ends[b + 1]]]


def small_ints(x: np.ndarray) -> bytes:
    """Numbers from 0 on, each in as few bytes as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if w == 8 or most < 1 << 8 * w)).tobytes()


def sized_ints(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1").astype(np.int64)


def ascending(x: np.ndarray) -> bytes:
    """Numbers in ascending order, by their steps."""
    steps = np.diff(x).astype(np.uint64)  # right modulo 2^64, whatever the ends
    return np.array([len(x), x[0]], "<i8").tobytes() + small_ints(steps)


def from_steps(data: bytes) -> np.ndarray:
    n, first = np.frombuffer(data[:16], "<i8").tolist()
    steps = np.frombuffer(data[16:], f"<u{(len(data) - 16) // (n - 1)}" if n > 1 else "<u1").astype(np.uint64)
    return np.cumsum(np.concatenate((np.array([first], np.int64).view(np.uint64), steps))).view(np.int64)


def asks_of(chunk: Chunk, number: int, buckets: int) -> pa.Table:
    """A row for each bucket: its edges' documents (id and number of edges), steps from position to position, and keys."""
    out = []
    for b, at in chunk.by_bucket(buckets):
        owner, start = chunk.owner[at], chunk.start[at]
        new = np.concatenate(([True], owner[1:] != owner[:-1]))
        steps = np.where(new, start, start - np.concatenate(([0], start[:-1])))
        heads = np.flatnonzero(new)
        keys = (chunk.h[at] & KEY).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
        out.append((b, number, ascending(chunk.doc[at][heads]), small_ints(np.diff(np.append(heads, len(at)))), small_ints(steps), keys.tobytes()))
    return pa.Table.from_pydict(dict(zip(("bucket", "chunk", "docs", "counts", "steps", "keys"), zip(*out, strict=True) if out else [[]] * 6, strict=True)), pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *((n, pa.binary()) for n in ("docs", "counts", "steps", "keys"))]))


def answers_of(asks: pa.Table) -> pa.Table:
    """For each edge of a bucket that also occurs in a smaller document: the coordinates of its first occurrence."""
    keys, docs, starts, source, at = [], [], [], [], []
    chunks, buckets = asks["chunk"].to_pylist(), asks["bucket"].to_pylist()
    for k, (d, c, s, q) in enumerate(zip(*(asks[n].to_pylist() for n in ("docs", "counts", "steps", "keys")), strict=True)):
        n = len(q) // 7
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :7] = np.frombuffer(q, np.uint8).reshape(n, 7)
        ids = from_steps(d)
        counts, steps = sized_ints(c, len(ids)), sized_ints(s, n)
        heads = np.cumsum(counts) - counts
        run = np.cumsum(steps)
        keys.append(wide.view("<u8").ravel())
        docs.append(np.repeat(ids, counts))
        starts.append(run - np.repeat(run[heads] - steps[heads], counts))
        source.append(np.full(n, k, np.int32))
        at.append(np.arange(n, dtype=np.int32))
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]  # of edges met twice or more
    docs, starts, source, at = (np.concatenate(x)[order] for x in (docs, starts, source, at))
    keys = keys[order]
    order = np.lexsort((starts, np.array(chunks, np.int64)[source], docs, keys))
    keys, docs, starts, source, at = (x[order] for x in (keys, docs, starts, source, at))
    new = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
    home = np.flatnonzero(new)[np.cumsum(new) - 1] if len(keys) else np.zeros(0, np.int64)
    found = np.flatnonzero(docs > docs[home])
    found = found[np.lexsort((at[found], source[found]))]
    ends = np.searchsorted(source[found], np.arange(len(chunks) + 1))
    out = []
    for k, c in enumerate(chunks):
        mine = found[ends[k] : ends[k + 1]]
        if len(mine):
            h = home[mine]
            out.append((c, buckets[k], at[mine].astype("<i4").tobytes(), np.array(chunks, "<i4")[source[h]].tobytes(), docs[h].astype("<i8").tobytes(), starts[h].astype("<i4").tobytes()))
    names = ("chunk", "bucket", "at", "home_chunk", "home_doc", "home_start")
    return pa.Table.from_pydict(dict(zip(names, zip(*out, strict=True) if out else [[]] * 6, strict=True)), pa.schema([(n, pa.int32() if n in ("chunk", "bucket") else pa.binary()) for n in names]))


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def paths_of(chunk: Chunk, number: int, answers: pa.Table, buckets: int) -> list[tuple]:
    """PATH's rows: the unbranched paths of a chunk's documents that run through smaller documents."""
    n = len(chunk.h)
    home_chunk, home_doc, home_start = np.full(n, number, np.int64), chunk.doc.copy(), chunk.start.astype(np.int64)
    told = {r["bucket"]: r for r in answers.to_pylist()}
    for b, at in chunk.by_bucket(buckets):
        if r := told.get(b):
            here = at[np.frombuffer(r["at"], "<i4")]
            home_chunk[here], home_doc[here], home_start[here] = np.frombuffer(r["home_chunk"], "<i4"), np.frombuffer(r["home_doc"], "<i8"), np.frombuffer(r["home_start"], "<i4")
    home_chunk, home_doc, home_start = home_chunk[chunk.first], home_doc[chunk.first], home_start[chunk.first]
    on = np.flatnonzero(home_doc < chunk.doc)
    if not len(on):
        return []
    follows = (np.diff(on) == 1) & (np.diff(chunk.owner[on]) == 0) & (np.diff(home_doc[on]) == 0) & (np.diff(home_chunk[on]) == 0) & (np.diff(home_start[on]) == 1)
    heads = np.flatnonzero(np.concatenate(([True], ~follows)))
    edges = np.diff(np.append(heads, len(on)))
    out = []
    for k, e in zip(on[heads].tolist(), edges.tolist(), strict=True):
        row, start, words = int(chunk.owner[k]), int(chunk.start[k]), e + chunk.window - 1
        out.append((number, row, start, words, int(home_chunk[k]), int(home_doc[k]), int(home_start[k]), digest(chunk.words[row][start : start + words])))
    return out


def once(rows: DataFrame) -> DataFrame:
    """(doc, text, copies): rows without those that are repeated whole, with their number. Only digests are counted for all rows; texts
    move where rows are repeated, combined before they do."""
    key = [F.xxhash64(F.lit(k), "text").alias(f"h{k}") for k in (1, 2)]
    often = cut(rows.select("doc", *key).groupBy("doc", "h1", "h2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    if often.isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long"))
    named = often.select(*(F.col(c).alias(f"of_{c}") for c in ("doc", "h1", "h2")), "copies")
    met = small_join(rows.select("*", *key), named, same(["doc", "h1", "h2"], ["of_doc", "of_h1", "of_h2"]), "left")
    alone = met.filter("copies is null").select("doc", "text", F.lit(1).cast("long").alias("copies"))
    return alone.unionByName(met.filter("copies is not null").groupBy("doc", "h1", "h2").agg(F.first("text").alias("text"), F.first("copies").alias("copies")).select("doc", "text", "copies"))


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, n_words, n_removed, kept) for each row of docs: `kept` are its words, joined by one space, but for those in a
    window of words that also starts in a document with a smaller id.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Windows are judged on the input, not on what is left. Null and empty texts
    have no words and keep ""; texts shorter than a window keep all. A null id is no source and loses nothing. Rows that
    share an id are one document: none is smaller than the other. Repeated rows come back each. An empty table gives an
    empty table.

    Documents are dealt into chunks and edges into as many buckets by hash. A chunk asks for each distinct edge once, so
    that an edge that a third of all documents hold is one entry per chunk; answers go back to the chunks. Chunks and
    buckets grow with the root of the text, from 4 MB (up to 64 GB of text) to 160 MB (100 TB), so that a chunk's row for a
    bucket always holds the edges of 256 bytes of text or more and the rows grow no faster than the text. A path that many
    documents hold is checked at its source once. Edges are told apart by 56 bits and their bucket; the check of each path
    compares 128 bits of its words, so a chance collision never removes anything. A text of any length is in one chunk; rows that
    are repeated whole are there once, with their number, and come back as often. Bytes that are not UTF-8 stay as they are;
    other columns are left out.
    """
    rows = once(docs.select(F.col(id).cast("long").alias("doc"), or_empty(F.col(text)).alias("text")))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    root = math.isqrt(size * ROW_BYTES)
    chunks, buckets = 1 + size // max(CHUNK_BYTES, root), 1 + size // max(BUCKET_BYTES, root)
    rows = rows.select("doc", "copies", squeezed(F.col("text")).alias("body"), F.pmod(F.xxhash64("doc", "text"), F.lit(chunks)).cast("int").alias("chunk"))

    def ask(rows: pa.Table) -> pa.Table:
        return asks_of(Chunk(rows, window), rows["chunk"][0].as_py(), buckets)

    def answer(asks: pa.Table) -> pa.Table:
        return answers_of(asks)

    def compact(rows: pa.Table, answers: pa.Table) -> pa.Table:
        number = rows["chunk"][0].as_py()
        found = paths_of(Chunk(rows, window), number, answers, buckets)
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in PATH.split(", "))])
        return pa.Table.from_pydict(dict(zip(schema.names, zip(*found, strict=True) if found else [[]] * len(schema), strict=True)), schema)

    def check(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asked):
            return asked
        texts: dict[int, list] = {}
        chunk = Chunk(rows, window, edges=False)
        for d, words in zip(chunk.ids, chunk.words, strict=True):
            texts.setdefault(d, []).append(words)
        held = [any(digest(w[r["home_start"] : r["home_start"] + r["words"]]) == r["digest"] for w in texts.get(r["home_doc"], [])) for r in asked.to_pylist()]
        return asked.filter(pa.array(held))

    def remove(rows: pa.Table, paths: pa.Table) -> pa.Table:
        chunk = Chunk(rows, window, edges=False)
        inside = [np.zeros(len(w) + 1, np.int64) for w in chunk.words]
        for row, start, words in zip(*(paths[n].to_pylist() for n in ("row", "start", "words")), strict=True):
            inside[row][start] += 1
            inside[row][start + words] -= 1
        stay = [np.cumsum(x)[:-1] == 0 for x in inside]
        kept = [b" ".join([w for w, s in zip(words, on.tolist(), strict=True) if s]) for words, on in zip(chunk.words, stay, strict=True)]
        sizes = np.array([len(w) for w in chunk.words], np.int64)
        left = np.array([int(s.sum()) for s in stay], np.int64)
        return pa.table({"doc": pa.array(chunk.ids, pa.int64()), "n_words": sizes, "n_removed": sizes - left, "kept": pa.array(kept, pa.binary()), "copies": pa.array(chunk.copies, pa.int64())})

    asks = rows.groupBy("chunk").applyInArrow(ask, ASK)
    answers = asks.groupBy("bucket").applyInArrow(answer, ANSWER)
    paths = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(compact, PATH)
    asked = paths.select(*HOME).distinct()
    held = rows.groupBy("chunk").cogroup(asked.groupBy("home_chunk")).applyInArrow(check, ", ".join(x for x in PATH.split(", ") if x.split()[0] in HOME))
    good = paths.join(held, HOME).select("chunk", "row", "start", "words")
    done = rows.groupBy("chunk").cogroup(good.groupBy("chunk")).applyInArrow(remove, "doc long, n_words long, n_removed long, kept binary, copies long")
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return done.select("doc", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), again.alias("copy")).drop("copy")


def op6_debruijn_dedup(spark, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    done = repeats(table(spark, sf_dir, "documents"))
    return done.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, i, len(ws) AS n, ws[i] AS w, CASE WHEN i + 12 <= len(ws) THEN array_to_string(ws[i:i+12], ' ') END AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
h AS (SELECT k, min(doc_id) AS first FROM u WHERE k IS NOT NULL GROUP BY k),
v AS (SELECT doc_id, i, w, bool_or(coalesce(first < doc_id, false)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM u LEFT JOIN h ON u.k = h.k)
SELECT d.doc_id, any_value(len(ws))::BIGINT AS n_words, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN v ON d.doc_id = v.doc_id GROUP BY d.doc_id
"""
