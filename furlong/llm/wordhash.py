"""64-bit hashes of the words of many texts at once.

A word's hash is a polynomial of random numbers for its bytes. The sums of all
words of a block of texts are taken together, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes hashed together; a longer text is cut at white space.
BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        step = np.uint64(pow(base, done, 1 << 64))
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
    return out


_POW: list[np.ndarray] = []


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _hash(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, start of each word) of bytes in which ``begins`` start texts."""
    if not _POW:
        _POW.extend([_powers(_BASE, 2 * BLOCK), _powers(pow(_BASE, -1, 1 << 64), 2 * BLOCK)])
    space = _SPACE[raw]
    start = ~space
    start[1:] &= space[:-1]
    begins = begins[begins < len(raw)]
    start[begins] = ~space[begins]
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, np.uint64), at
    sums = np.add.reduceat(_BYTE[raw] * _POW[0][: len(raw)], at)
    return scramble(sums * _POW[1][at]), at


def _long(raw: np.ndarray) -> np.ndarray:
    """Hashes of a text longer than a block; a word longer than a block is summed in parts."""
    parts, a = [], 0
    while a < len(raw):
        b = min(a + BLOCK, len(raw))
        if b < len(raw):
            spaces = np.flatnonzero(_SPACE[raw[a:b]])
            if len(spaces):
                b = a + int(spaces[-1]) + 1
            else:  # within a word: the rest of it, as one word of its block hashes
                more = np.flatnonzero(_SPACE[raw[b:]])
                b = b + int(more[0]) if len(more) else len(raw)
        if b - a > 2 * BLOCK:
            total = np.uint64(0)
            for i in range(a, b, BLOCK):
                part = scramble(_hash(raw[i : min(i + BLOCK, b)], np.zeros(1, int))[0])
                total = scramble(np.array([total]))[0] + part.sum(dtype=np.uint64)
            parts.append(np.array([total], np.uint64))
        else:
            parts.append(_hash(raw[a:b], np.zeros(1, int))[0])
        a = b
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def hashed_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text of a binary array, in order; null as empty."""
    wide = pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32) if len(texts) else np.zeros(1, np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    with np.errstate(over="ignore"):
        while row < len(texts):
            first = offsets[row]
            last = max(row + 1, int(np.searchsorted(offsets, first + BLOCK, "right")) - 1)
            if offsets[row + 1] - first > BLOCK:
                yield _long(raw[first : offsets[row + 1]])
                row += 1
                continue
            begins = offsets[row : last + 1] - first
            hashes, at = _hash(raw[first : offsets[last]], begins[:-1])
            cut = np.searchsorted(at, begins)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                yield hashes[a:b]
            row = last
