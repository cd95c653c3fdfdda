"""Words and word shingles of UTF-8 texts as 64-bit hashes, vectorised over bytes.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lowered.
Equal words always hash alike; different ones collide with the odds of random
64-bit values.  Texts are read in blocks, so memory follows the number of
words, not eight times the number of bytes.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BLOCK = 1 << 18
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = [9, 10, 11, 12, 13, 32]
_BYTE[_SPACES] = 0
_IS_WORD = _BYTE != 0
_P = 0x9E3779B97F4A7C15 | 1
_LANES = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
    return out


_UP = _powers(_P, _BLOCK)
_DOWN = _powers(pow(_P, -1, 1 << 64), _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _block_words(block: bytes) -> np.ndarray:
    b = np.frombuffer(block, np.uint8)
    inside = _IS_WORD[b]
    edges = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    starts = np.concatenate(([0], edges)) if len(b) and inside[0] else edges
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.add.reduceat(_BYTE[b] * _UP[: len(b)], starts)
    return mix(sums * _DOWN[starts])


def _long_word(word: bytes) -> np.uint64:
    """A word longer than a block: the same polynomial, summed block by block."""
    total, shift = 0, 1
    step = pow(_P, _BLOCK, 1 << 64)
    for k in range(0, len(word), _BLOCK):
        b = np.frombuffer(word[k : k + _BLOCK], np.uint8)
        total += int((_BYTE[b] * _UP[: len(b)]).sum(dtype=np.uint64)) * shift
        shift = shift * step % (1 << 64)
    return mix(np.array([total % (1 << 64)], np.uint64))[0]


def word_hashes(text: bytes) -> np.ndarray:
    """One uint64 per word, in order."""
    low = text.lower()  # bytes.lower touches A-Z only
    if len(low) <= _BLOCK:
        return _block_words(low)
    parts, at = [], 0
    while at < len(low):
        end = min(at + _BLOCK, len(low))
        if end < len(low):
            cut = max(low.rfind(bytes([s]), at, end) for s in _SPACES)
            if cut < 0:
                stops = [p for s in _SPACES if (p := low.find(bytes([s]), end)) >= 0]
                end = min(stops, default=len(low))
                parts.append(np.array([_long_word(low[at:end])], np.uint64))
                at = end
                continue
            end = cut + 1
        parts.append(_block_words(low[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_sequence(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles in order; a shorter text is one shingle, none without words."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < SHINGLE:
        return mix(((words * _LANES[:n]).sum(dtype=np.uint64) + np.uint64(n)).reshape(1))
    m = n - SHINGLE + 1
    out = words[:m] * _LANES[0]
    for k in range(1, SHINGLE):
        out += words[k : k + m] * _LANES[k]
    return mix(out)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingles of a text."""
    return np.unique(shingle_sequence(word_hashes(text)))
