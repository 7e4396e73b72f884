"""Token counts by greedy longest match, from an automaton that never builds the pieces."""

import itertools
from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytable.llm.bpe import byte_pieces, in_portions
from daytable.llm.common import in_small_batches, table

#: What a task remembers: words, and bytes of them together.
MOST_WORDS, MOST_BYTES = 300_000, 12_000_000


class Automaton:
    """A trie of pieces with failure links, each with the number of pieces that are complete when it is followed.

    Matching a text from a node takes the next byte's edge, or else follows the node's link and adds its count, as often as
    needed; each link shortens what is unmatched, so a text takes time linear in its bytes. `keys` holds the edges,
    node * 256 + byte in ascending order, and `to` their ends. A link of -1 says that no pieces can cover the text.
    """

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    whole.append(False)
                node = children[node][byte]
            whole[node] = node != 0
        link, popped = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in children[node].items():
                queue.append(child)
                if whole[child]:
                    link[child], popped[child] = 0, 1
                    continue
                at, n = link[node], popped[node]
                while at >= 0 and byte not in children[at]:
                    at, n = link[at], n + popped[at]
                if at >= 0:
                    link[child], popped[child] = children[at][byte], n
        edges = sorted((node * 256 + byte, child) for node, ends in enumerate(children) for byte, child in ends.items())
        self.keys, self.to = (np.array(c, np.int64) for c in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
        self.link, self.popped = np.array(link, np.int64), np.array(popped, np.int64)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.keys, self.to, self.link, self.popped

    @classmethod
    def of(cls, arrays: tuple[np.ndarray, ...]) -> "Automaton":
        made = cls.__new__(cls)
        made.keys, made.to, made.link, made.popped = arrays
        return made

    def step(self, nodes: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is an edge, its end) for each node and byte."""
        wanted = nodes * 256 + bytes_
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted, self.to[at]

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """How many pieces each word has; 1, for the unknown piece, where pieces cannot cover it. All words advance at once."""
        if not words:
            return np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")  # longest first: those that go on are always the first ones
        begin = (np.cumsum(sizes) - sizes)[order]
        node, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        going = -np.sort(-sizes)
        for k in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-going, -k, "left"))  # words longer than k
            rest = np.flatnonzero(node[:n] >= 0)
            while len(rest):
                found, to = self.step(node[rest], data[begin[rest] + k])
                node[rest[found]] = to[found]
                rest = rest[~found]
                count[rest] += self.popped[node[rest]]
                node[rest] = self.link[node[rest]]
                rest = rest[node[rest] >= 0]
        rest = np.flatnonzero(node > 0)
        while len(rest):
            count[rest] += self.popped[node[rest]]
            node[rest] = self.link[node[rest]]
            rest = rest[node[rest] > 0]
        out = np.empty(len(words), np.int64)
        out[order] = np.where(node < 0, 1, count)
        return out


def token_counts(text: Column, spark, pieces: list[bytes], mark: bytes = b" ") -> Column:
    """A struct n_words, n_tokens of a text: its [\\x20\\x09-\\x0D]-separated words, and the pieces that greedy longest match
    splits them into, each word with `mark` before it. Null and empty texts have none.

    The automaton is broadcast; its size is the vocabulary's, whatever the input. Words are counted once per task, as far
    as MOST_WORDS and MOST_BYTES of them are remembered.
    """
    arrays = spark.sparkContext.broadcast(Automaton(pieces).arrays())  # plain arrays: workers need no class of ours to read them

    task: dict = {}  # filled by each task

    @F.arrow_udf("struct<n_words:bigint,n_tokens:bigint>")
    def of(texts: pa.Array) -> pa.Array:
        if len(task.get("numbers", ())) > MOST_WORDS or task.get("held", 0) > MOST_BYTES:
            task.clear()
        numbers, known = task.get("numbers", {}), task.get("known", np.zeros(0, np.int64))
        words, tokens, automaton = [], [], Automaton.of(arrays.value)
        for portion in in_portions([x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]):
            split = [t.split() for t in portion]
            new = [w for w in set(itertools.chain.from_iterable(split)) if w not in numbers]
            task["held"] = task.get("held", 0) + sum(map(len, new))
            numbers.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            known = np.concatenate((known, automaton.lengths([mark + w for w in new])))
            n = np.array([len(s) for s in split], np.int64)
            each = known[np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n.sum()))]
            ends = np.concatenate(([0], np.cumsum(each)))[np.cumsum(np.concatenate(([0], n)))]
            words.append(n)
            tokens.append(np.diff(ends))
        task.update(numbers=numbers, known=known)
        empty = [np.zeros(0, np.int64)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x + empty)) for x in (words, tokens)], ["n_words", "n_tokens"])

    return of(text)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, into: str = "tokens") -> DataFrame:
    """docs with the struct of token_counts as `into`, over the pieces of a byte-level vocabulary file.

    All rows and columns come back (a column itself named `into` is replaced); an empty table gives an empty table. A
    word of any length takes time linear in it.
    """
    pieces = list(byte_pieces(path or public_tokenizers.path("byte_bpe_50k.json")))
    return docs.withColumn(into, token_counts(F.col(text), docs.sparkSession, pieces))


def op7_longest_match_counts(spark, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "tokens.n_words", "tokens.n_tokens")
