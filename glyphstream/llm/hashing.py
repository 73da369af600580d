"""Word and word-run hashes of whole batches of texts, vectorised.

Words are runs of bytes other than ASCII space and tab to carriage return, so
they agree with ``[^\\x20\\x09-\\x0D]+``. Hashes are polynomials modulo 2^64,
finished by a mixing function; running sums make all of a batch's in a few
passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes hashed together; a longer text is a batch of its own.
CHUNK = 1 << 19
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK), b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """[first, last) of runs of texts with about ``size`` bytes together."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes], lines: bool = False) -> tuple[np.ndarray, ...]:
    """The hash of every word, and the number of words of each text; with ``lines`` also the words' places
    in the batch and the places of its line breaks and of the ends of its texts."""
    buf = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    power, inverse = _up_to(len(buf))
    blank = _SPACE[buf]
    turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = turn[::2], turn[1::2]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts])
    limits = np.cumsum([len(t) + 1 for t in texts]) + 1
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    return (words, counts, starts, np.concatenate([np.flatnonzero(buf == 10), limits])) if lines else (words, counts)


def sums_of(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A polynomial of the words of each run [first, last)."""
    power, inverse = _up_to(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return (sums[last] - sums[first]) * inverse[first]


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k words in a row, over the batch; those across texts are the caller's to skip."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * np.uint64(pow(_BASE, j + 1, 1 << 64))
    return mix(total)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct k-word shingles; all of its words as one, if fewer; empty without words."""
    words, counts = word_hashes(texts)
    runs, at = run_hashes(words, k), 0
    for n in counts.tolist():
        if n >= k:
            yield np.unique(runs[at : at + n - k + 1])
        elif n:
            yield run_hashes(words[at : at + n], n) ^ np.uint64(n)
        else:
            yield np.zeros(0, np.uint64)
        at += n
