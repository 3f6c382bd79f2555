"""Sets of word shingles as sorted 64-bit hashes, for many documents at a time in numpy.

Words are maximal runs without white space, A-Z lower-cased. A word's hash sums random 64-bit values of its bytes times
powers of an odd number, then mixes in its length; a shingle's hash combines its words' hashes by place."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Longer texts are hashed in parts that end between words.
PART = 4 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser), after adding salt."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1 << 10, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n or _POWERS[1] == 1:
        _POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 10), _BASE, np.uint64)]))
    return _POWERS


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a byte buffer."""
    inside = np.concatenate([[False], ~_SPACE[buf], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lengths = ends - starts
    chars = np.flatnonzero(inside[1:-1])
    first = np.cumsum(lengths) - lengths
    value = _BYTE[buf[chars]] * powers(int(lengths.max()))[np.arange(len(chars)) - np.repeat(first, lengths)]
    return starts, mix(np.add.reduceat(value, first) + mix(lengths.astype(np.uint64), 5))


def words_by_document(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush() -> None:
        if held:
            lens = np.fromiter((len(t) + 1 for t in held), np.int64, len(held))
            starts, hashes = word_hashes(np.frombuffer(b" ".join(held) + b" ", np.uint8))
            cut = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens)]))
            out.extend(hashes[cut[i] : cut[i + 1]] for i in range(len(held)))
            held.clear()

    n = 0
    for t in texts:
        if len(t) > PART:
            flush()
            n, at, parts = 0, 0, []
            while at < len(t):
                end = at + PART
                while end < len(t) and t[end] not in b" \t\n\v\f\r":
                    end += 1
                parts.append(word_hashes(np.frombuffer(t[at:end], np.uint8))[1])
                at = end
            out.append(np.concatenate(parts))
            continue
        if n + len(t) > PART:
            flush()
            n = 0
        held.append(t)
        n += len(t)
    flush()
    return out


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and sorted distinct shingle hashes of all texts, one after the other. A text with fewer than k words has its
    whole sequence as its only shingle, one without words has none."""
    sets: list[np.ndarray] = []
    for w in words_by_document(texts):
        n = len(w)
        if n >= k:
            h = sum((w[j : n - k + 1 + j] * _PLACE[j] for j in range(1, k)), w[: n - k + 1] * _PLACE[0])
            h = mix(h, k)
            h.sort()
            sets.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif n:
            sets.append(mix(np.array([(w * _PLACE[:n]).sum()], np.uint64), n))
        else:
            sets.append(np.empty(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return bounds, np.concatenate(sets) if sets else np.empty(0, np.uint64)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of values between bounds; 0 for empty ranges."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]
