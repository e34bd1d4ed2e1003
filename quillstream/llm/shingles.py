"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed a batch at a time with array passes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
#: A random value for each byte: A-Z count as a-z; white space (0x20, 0x09-0x0D) is nothing.
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE[_SPACE] = 0
_FACTOR = 0x9E3779B97F4A7C15
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(8, (n - 1).bit_length())
        _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _FACTOR, dtype=np.uint64))))
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    ends = np.cumsum(lengths)
    space = _SPACE[data]
    starts = np.nonzero(~space & np.concatenate(([True], space[:-1])))[0]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    sizes = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
    value = _VALUE[data[starts[0] :]]
    h = np.add.reduceat(value * power_table(int(sizes.max()))[place], starts - starts[0])
    upto = np.searchsorted(starts, ends)
    return mix(h), np.diff(np.concatenate(([0], upto)))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; all words as one where there are fewer; none without words."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    n = len(words)
    if n >= k:
        full = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            full += words[i : n - k + 1 + i] * _PLACE[i]
        full = mix(full)
    for c in counts.tolist():
        if c >= k:
            h = np.sort(full[at : at + c - k + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif c:
            out.append(mix((words[at : at + c] * _PLACE[k : k + c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += c
    return out
