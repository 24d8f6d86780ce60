"""Vectorised hashes of words, word shingles and byte windows, for whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Odd, so that powers have inverses modulo 2**64.
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of texts that are hashed at a time.
CHUNK = 1 << 19


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 4096), base, U)
        steps[0] = U(1)
        have = _POWERS[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits (splitmix64's finaliser)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] hashes data[:i]; windows' hashes follow by difference."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` bytes window of ``data``, equal for equal windows wherever they stand."""
    h = prefix_hash(data)
    n = len(data) - size + 1
    return mixed((h[size:] - h[:n]) * powers(INVERSE, n)) if n > 0 else np.zeros(0, U)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the place of each text's first word (and the end); words are runs of anything but ASCII white space."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    h = prefix_hash(data)
    words = mixed((h[ends] - h[starts]) * powers(INVERSE, len(data))[starts])
    return words, np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))


def shingles(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of each text.

    A text of fewer words, but one at least, has one shingle of all its words; words are
    runs of anything but ASCII white space.
    """
    out: list[np.ndarray] = []
    for part in _chunks(texts):
        w, first = word_hashes(part)
        m = U(0xD1342543DE82EF95)
        if len(w) >= words:
            s = w[: len(w) - words + 1].copy()
            for k in range(1, words):
                s = s * m + w[k : len(w) - words + 1 + k]
            s = mixed(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(s[a : b - words + 1]))
            elif b > a:
                one = np.array([b - a], U)
                for x in w[a:b]:
                    one = one * m + x
                out.append(mixed(one))
            else:
                out.append(np.zeros(0, U))
    return out


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size > CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part
