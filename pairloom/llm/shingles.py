"""Sets of word shingles as sorted 64-bit hashes, made whole batches at a time.

Words are runs of bytes other than space and the bytes 9 to 13, with A-Z in
lower case. A shingle is five words in order; a text with fewer words has one
shingle of all of them; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit (in place)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _table() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    value = mix(np.arange(1, 257, dtype=np.uint64) * ODD)[lower]
    value[blank] = 0
    return value, blank


VALUE, BLANK = _table()
#: Bytes that are summed at a time, and places in a word whose factors are held.
SPAN = 1 << 16


def _factors(begin: int, end: int) -> np.ndarray:
    """Unrelated 64-bit numbers for the places of a word's bytes."""
    return mix(~np.arange(begin + 1, end + 1, dtype=np.uint64) * ODD)


FACTORS = _factors(0, SPAN)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of the bytes ``data``.

    Every byte's value is multiplied by the factor of its place in the word; the
    sum is mixed. The factors are unrelated to each other, unlike the powers of a
    polynomial, whose structure some long words share.
    """
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.append(0, edge)
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        begin = int(starts[done])
        until = int(np.searchsorted(ends, begin + SPAN, side="right"))
        if until == done:  # a word of more than SPAN bytes
            sums[done] = _long(data[begin : int(ends[done])])
            done += 1
            continue
        at = starts[done:until] - begin
        part = VALUE[data[begin : int(ends[until - 1])]]
        place = np.arange(len(part))
        place -= np.repeat(at, np.diff(at, append=len(part)))
        part *= FACTORS[place]  # blanks have the value 0
        sums[done:until] = np.add.reduceat(part, at)
        done = until
    sums += (ends - starts).astype(np.uint64) * ODD
    return mix(sums)


def _long(word: np.ndarray) -> np.uint64:
    """As ``word_hashes`` sums one word, a span at a time."""
    total = np.zeros(1, np.uint64)
    for at in range(0, len(word), SPAN):
        part = VALUE[word[at : at + SPAN]]
        total += (part * (_factors(at, at + len(part)) if at else FACTORS[: len(part)])).sum(dtype=np.uint64)
    return total[0]


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    word = word_hashes(data)
    if not len(word):
        return word
    size = min(words, len(word))
    count = len(word) - size + 1
    total = np.full(count, np.uint64(size))
    for j in range(size):
        total *= ODD
        total += word[j : j + count]
        total ^= total >> np.uint64(29)
    total = mix(total)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]
