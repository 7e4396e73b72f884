"""Token ids of a byte-level BPE vocabulary, over many texts."""

import itertools
import json
from array import array

import numpy as np

#: How the vocabulary's texts are split before merging (fixed values, as the tokenizer file has them).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode's White_Space, which is what \s means there.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No match of PATTERN crosses the ends of these: a word with the one space before it, white space before that.
SEGMENT = f"[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]"
#: What an encoder remembers: segments, and characters and ids of them together.
MOST_SEGMENTS, MOST_HELD = 300_000, 12_000_000


def byte_pieces(path: str) -> dict[bytes, int]:
    """The bytes and id of each piece of a tokenizer file, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {x["content"] for x in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in piece): n for piece, n in spec["model"]["vocab"].items() if piece not in special}


def splits_like_pattern(spec: dict) -> bool:
    """Whether a tokenizer file leaves texts as they are, splits them as PATTERN does, and merges by the order of its ids."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or odd or model.get("type") != "BPE":
        return False
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return all(a < b for a, b in itertools.pairwise(merged)) and min(merged, default=0) >= 0


class Encoder:
    """Gives each text the ids that the tokenizers library gives it (add_special_tokens=False).

    Where the file splits texts as PATTERN does, a segment seen before is looked up and a new one is merged by tiktoken,
    which does the same merges several times faster. Texts that hold the string of a special token, and all texts under
    files of another kind, go to the tokenizers library itself. What is remembered is bounded.
    """

    def __init__(self, path: str):
        import re

        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.quick = splits_like_pattern(spec)
        if not self.quick:
            return
        self.merge = tiktoken.Encoding("daytable", pat_str=PATTERN, mergeable_ranks=byte_pieces(path), special_tokens={}).encode_ordinary
        self.segments = re.compile(SEGMENT).findall
        self.forget()

    def forget(self) -> None:
        flat, starts, sizes, merge = array("I"), array("q"), array("q"), self.merge

        class Numbers(dict):
            held = 0

            def __missing__(self, segment: str) -> int:
                ids = merge(segment)
                self.held += len(segment) + len(ids)
                starts.append(len(flat))
                sizes.append(len(ids))
                flat.extend(ids)
                self[segment] = n = len(self)
                return n

        self.numbers, self.flat, self.starts, self.sizes = Numbers(), flat, starts, sizes

    def plain(self, text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        if not hasattr(self, "slow"):
            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.quick:
            return [self.plain(t) for t in texts]
        if len(self.numbers) > MOST_SEGMENTS or self.numbers.held > MOST_HELD:
            self.forget()
        split = [[] if any(s in t for s in self.special) else self.segments(t) for t in texts]
        found = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(split)), np.int64)
        sizes, starts = np.array(self.sizes, np.int64)[found], np.array(self.starts, np.int64)[found]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.array(self.flat, np.uint32)[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]
        at = np.concatenate(([0], ends))[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] if segments or not text else self.plain(text) for text, segments, a, b in zip(texts, split, at[:-1], at[1:], strict=True)]


def in_portions(texts: list, most: int = 2_000_000):
    """Runs of texts of about `most` characters together, one text at least."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > most:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run
