"""Encoding of texts with a public byte-level BPE vocabulary: speculate and verify.

Greedy longest match proposes the tokens of every new word; then each adjacent pair of
proposed tokens is tested at once, as arrays: a pair is compatible if merging by rank
would never choose a token across its border. A word all of whose pairs are compatible is
encoded right (single tokens encode to themselves); only the others are merged exactly.
"""

from __future__ import annotations

import json
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: The public pre-tokenisation pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a Python worker; beyond, it starts afresh.
CACHE_WORDS = 200_000
#: Bytes from which on a word is merged with a heap.
LONG_WORD = 100


@cache
def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """The bytes of every token, and the merges (left id, right id, merged id) by rank."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    tokens = [b""] * (max(model["vocab"].values()) + 1)
    for text, i in model["vocab"].items():
        if all(c in letters for c in text):
            tokens[i] = bytes(letters[c] for c in text)
    merges = []
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((model["vocab"][a], model["vocab"][b], model["vocab"][a + b]))
    return tokens, merges


class Encoder:
    """Tables of one vocabulary, and the words encoded so far."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]) -> None:
        made = {m for *_, m in merges}
        self.ids = {t: i for i, t in enumerate(tokens) if t and (len(t) == 1 or i in made)}
        n = len(tokens)
        self.left, self.right = np.arange(n), np.arange(n)
        for a, b, m in merges:
            self.left[m], self.right[m] = a, b
        # the order in which tokens are made; single bytes come first
        self.rank = np.zeros(n, np.int64)
        self.rank[[m for *_, m in merges]] = np.arange(1, len(merges) + 1)
        self.order = {(a, b): k for k, (a, b, _) in enumerate(merges)}
        self.made = [m for *_, m in merges]
        keys = np.array([a * n + b for a, b, _ in merges], np.int64)
        order = np.argsort(keys)
        self.n, self.pair_keys = n, keys[order]
        self.pair_rank = self.rank[[m for *_, m in merges]][order]
        self.longest: dict[bytes, int] = {}
        for t in self.ids:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 0), len(t))
        self.split = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, ids = [], 0, self.ids
        while i < len(word):
            for size in range(min(self.longest.get(word[i : i + 2], 1), len(word) - i), 0, -1):
                t = ids.get(word[i : i + size])
                if t is not None:
                    break
            out.append(t)
            i += size
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging keeps the border between them.

        The later-made token of a pair is taken apart on the side of the border, back
        through its merges; the border falls if two neighbours there have a merge made
        before the point in time that undoing has reached.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            keys = a * self.n + b
            pos = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            falls = (self.pair_keys[pos] == keys) & (self.pair_rank[pos] < limit)
            good[at[falls]] = False
            ra, rb = self.rank[a], self.rank[b]
            # at equal times the left of two equal merges happens first
            undo_a = ra > rb
            both_bytes = (ra == 0) & (rb == 0)
            limit = np.where(undo_a, ra, rb + 1)
            a = np.where(undo_a, self.right[a], a)
            b = np.where(undo_a, b, self.left[b])
            live = ~falls & ~both_bytes
            at, a, b, limit = at[live], a[live], b[live], limit[live]
        return good

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank, for words whose proposal isn't confirmed."""
        if len(word) > LONG_WORD:
            return self._exact_long(word)
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        order, never = self.order.get, len(self.made)
        ranks = [order(p, never) for p in zip(parts, parts[1:])]
        while ranks and (first := min(ranks)) < never:
            token, i = self.made[first], 0
            while True:
                try:
                    i = ranks.index(first, i)
                except ValueError:
                    break
                parts[i : i + 2] = [token]
                del ranks[i]
                if i:
                    ranks[i - 1] = order((parts[i - 1], token), never)
                if i < len(ranks):
                    ranks[i] = order((token, parts[i + 1]), never)
        return parts

    def _exact_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs and linked parts: the time grows with n log n."""
        parts: list[int] = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := self.order.get(p)) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            # a pair that has changed since is of another rank, or gone
            if parts[i] < 0 or j >= n or self.order.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := self.order.get((parts[left], parts[right]))) is not None:
                    heappush(heap, (r, left))
        return [p for p in parts if p >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode new words into the cache."""
        raw = [w.encode("utf-8") for w in words]
        proposed = [self.propose(w) for w in raw]
        sizes = np.array([len(p) for p in proposed], np.int64)
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pairs, back = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.n, pairs % self.n)[back]
        failing = set(owner[inner[~fine]].tolist())
        for k, w in enumerate(words):
            self.known[w] = tuple(self.exact(raw[k]) if k in failing else proposed[k])

    def encode_batch(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """The encoded words of every text; a null or empty text has none."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        split = [self.split.findall(t) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        if new:
            self.learn(list(new))
        return [[self.known[w] for w in words] for words in split]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, shared) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*shared.value)
    return _ENCODERS[key]


def _slices(texts: pa.Array, chars: int = 4_000_000):
    """Stretches of a batch of about so many bytes, so that long texts don't pile up."""
    start, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        size += n or 0
        if size > chars:
            yield texts.slice(start, i + 1 - start)
            start, size = i + 1, 0
    yield texts.slice(start)


def _shared(spark: SparkSession, tokenizer: str, tokenizer_dir: str):
    """The vocabulary on the workers: its size is fixed by the tokenizer file."""
    path = f"{tokenizer_dir}/{tokenizer}.json"
    return path, spark.sparkContext.broadcast(read_vocabulary(path))


def token_ids(spark: SparkSession, column: Column | str, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> Column:
    """Token ids (array<int>) of a text column, without special tokens.

    A null or empty text gives an empty list; strings of special tokens are ordinary text;
    whole texts are encoded whatever their length.
    """
    key, shared = _shared(spark, tokenizer, tokenizer_dir)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        enc = _encoder(key, shared)
        flats, sizes = [], [np.zeros(1, np.int64)]
        for part in _slices(texts):
            words = enc.encode_batch(part.to_pylist())
            flat = [list(chain.from_iterable(w)) for w in words]
            sizes.append(np.array([len(x) for x in flat], np.int64))
            flats.append(np.fromiter(chain.from_iterable(flat), np.int32, int(sizes[-1].sum())))
        offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flats) if flats else np.zeros(0, np.int32)))

    return encode(column)


def token_count(spark: SparkSession, column: Column | str, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> Column:
    """The number of tokens of a text column; 0 for a null or empty text."""
    key, shared = _shared(spark, tokenizer, tokenizer_dir)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        enc = _encoder(key, shared)
        return pa.array([sum(map(len, w)) for part in _slices(texts) for w in enc.encode_batch(part.to_pylist())], pa.int64())

    return count(column)
