"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

One bucket per merge rank holds linked-list positions. A bitmap with one bit per
rank, and above it one bit per 64 ranks, finds the lowest non-empty bucket by
find-first-set. An entry is stale when the pair now standing at its position has
another rank; stale entries are skipped when their bucket comes up. A bucket is
taken as a whole, with numpy, so one pass of the queue serves every distinct
pre-token of a batch, and a pre-token of any length costs its own length only.

Null text is empty text. Empty text gives no ids. Rows keep their other columns;
a column already named like an output is replaced.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that one pass of the queue takes; bounds a worker's memory.
PASS_CHARS = 12_000_000
NONE = np.int32(2**31 - 1)
#: A pattern over Unicode classes written with the classes of ``re``, which is
#: faster, for texts in whose characters both agree.
CLASSES = {r"[^\s\p{L}\p{N}]": r"(?:[^\s\w]|_)", r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d"}
OTHER = re.compile("[^\x00-\x1b\x20-\x7f\u00a1\u00ab\u00bb\u00bf-\u024f\u2010-\u2027]")


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank with all its positions."""

    def __init__(self, ranks: int) -> None:
        self.words = [0] * ((ranks >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        ends = [*starts[1:].tolist(), len(ranks)]
        for rank, start, end in zip(ranks[starts].tolist(), starts.tolist(), ends, strict=True):
            held = self.buckets.get(rank)
            if held is None:
                self.buckets[rank] = [positions[start:end]]
                self.words[rank >> 6] |= 1 << (rank & 63)
                self.top |= 1 << (rank >> 6)
            else:
                held.append(positions[start:end])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        bit = (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.words[word] = bits
        if not bits:
            self.top &= self.top - 1
        held = self.buckets.pop((word << 6) | bit)
        return (word << 6) | bit, held[0] if len(held) == 1 else np.concatenate(held)


class Vocabulary:
    """Ranks of a ``.tiktoken`` file, with a lookup from two ids to their merge."""

    def __init__(self, path: str, pattern: str) -> None:
        lines = Path(path).read_bytes().splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        for unicode, plain in CLASSES.items():
            pattern = pattern.replace(unicode, plain)
        self.plain = self.pattern if "\\p" in pattern else re.compile(pattern)
        keys, merged = [], []
        wide = self.size + 1  # the last id stands beyond either end and merges with nothing
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * wide + b)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of ids a and b, NONE where there is none."""
        key = a.astype(np.int64) * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and where each piece's begin."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum())
        bounds = np.r_[0, np.cumsum(sizes)]
        if not n:
            return np.zeros(0, np.int32), bounds
        ids = np.append(self.bytes[np.frombuffer(b"".join(pieces), np.uint8)], np.int32(self.size))
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        full = bounds[:-1][sizes > 0]
        before[full] = n  # position n stands for "no neighbour"
        after[bounds[1:][sizes > 0] - 1] = n
        after[n] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        rank = self.pair(ids, ids[after])
        queue = RankQueue(self.size)
        ready = np.flatnonzero(rank != NONE).astype(np.int32)
        queue.push(rank[ready], ready)
        while (found := queue.pop()) is not None:
            lowest, at = found
            at = at[rank[at] == lowest]  # others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                touching = after[at[:-1]] == at[1:]
                if touching.any():  # in a run of overlapping pairs every second one stays, from the left
                    number = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.r_[True, ~touching], number, 0))
                    at = at[(number - start) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            ids[at] = lowest
            alive[gone] = False
            rank[gone] = NONE
            after[at] = beyond
            before[beyond] = at
            before[n] = n
            left = before[at]
            changed = np.concatenate((at, left[left != n]))
            new = self.pair(ids[changed], ids[after[changed]])
            rank[changed] = new
            some = new != NONE
            queue.push(new[some], changed[some])
        starts = np.r_[0, np.cumsum(alive[:n])][bounds]
        return ids[:n][alive[:n]], starts

    def split(self, text: str) -> list[str]:
        return (self.pattern if OTHER.search(text) else self.plain).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        number: defaultdict[str, int] = defaultdict(count().__next__)
        seen = [np.fromiter(map(number.__getitem__, found := self.split(t)), np.int32, len(found)) for t in texts]
        pieces = [p.encode("utf-8", "surrogatepass") for p in number]
        del number
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        ids, starts = self.merge([b"" if r >= 0 else p for p, r in zip(pieces, whole.tolist(), strict=True)])
        many = np.where(whole >= 0, 1, np.diff(starts))
        # pieces that are one token as a whole stand behind the merged ones
        single = np.flatnonzero(whole >= 0)
        begin = starts[:-1].copy()
        begin[single] = len(ids) + np.arange(len(single))
        ids = np.concatenate((ids.astype("<u4"), whole[single].astype("<u4")))
        out = []
        for piece in seen:
            size = many[piece]
            total = int(size.sum())
            offset = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            out.append(ids[np.repeat(begin[piece], size) + offset].tobytes())
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once in each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    return _LOADED[path, pattern]


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of ``text`` as a binary column of little-endian unsigned 32-bit integers."""

    @F.pandas_udf(T.BinaryType())
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path, pattern)
        held: list[pd.Series] = []
        chars = 0

        def flush() -> Iterator[pd.Series]:
            coded = vocab.encode([t for s in held for t in s])
            at = 0
            for s in held:
                yield pd.Series(coded[at : at + len(s)])
                at += len(s)

        for batch in batches:
            held.append(batch.fillna(""))
            chars += int(held[-1].str.len().sum())
            if chars >= PASS_CHARS:
                yield from flush()
                held, chars = [], 0
        if held:
            yield from flush()

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids of ``encode`` stand for, as a binary column; null gives none."""

    @F.pandas_udf(T.BinaryType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            yield pd.Series([b"" if x is None else vocab.decode(x) for x in batch])

    return text(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids``; ids are kept as binary, four bytes each."""
    return docs.withColumn(ids, encode(F.col(f"`{text}`"), path, pattern))


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with a column ``decoded`` of bytes."""
    return docs.withColumn(out, decode(F.col(f"`{ids}`"), path, pattern))
