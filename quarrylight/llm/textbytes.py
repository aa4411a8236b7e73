"""Words and shingles of whole texts as numbers, for the operators that work on Arrow batches.

Texts are laid end to end in blocks and handled by numpy as a whole: word boundaries from a table of bytes, word hashes
from eight bytes at a time, shingles from the hashes of adjacent words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

#: Bytes of text that are laid out at once; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000
#: Words longer than this are hashed one by one.
LONG_WORD = 256
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all bodies, A-Z in lower case, and the first word of each body."""
    raw = b" ".join(bodies).lower() + b" " + bytes(8)
    n = len(raw) - 8
    gap = _GAP[np.frombuffer(raw, dtype=np.uint8, count=n)]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, length = edge[::2], edge[1::2] - edge[::2]
    lanes = np.ndarray(n, dtype="<u8", buffer=raw, strides=(1,))
    h = mix64(length.astype(np.uint64) * _STEP)
    some = np.flatnonzero(length <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        some = some[length[some] > at]
        if not len(some):
            break
        left = np.minimum(length[some] - at, 8).astype(np.uint64)
        lane = lanes[start[some] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        h[some] = mix64(h[some] * _STEP + lane)
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + length[i]])
    begins = np.cumsum([0] + [len(b) + 1 for b in bodies])
    return h, np.searchsorted(start, begins)


def _chained(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all runs of ``m`` adjacent words."""
    out = mix64(h[: len(h) - m + 1])
    for j in range(1, m):
        out = mix64(out * _STEP + h[j : len(h) - m + 1 + j])
    return out


def _blocks(texts: Sequence[str | None]) -> Iterator[list[bytes]]:
    block, held = [], 0
    for t in texts:
        body = t.encode("utf-8", "surrogatepass") if t else b""
        if block and held + len(body) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append(body)
        held += len(body)
    if block:
        yield block


def shingle_sets(texts: Sequence[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles; of fewer words, the whole sequence as one."""
    for bodies in _blocks(texts):
        h, first = _word_hashes(bodies)
        runs = _chained(h, k) if len(h) >= k else h[:0]
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                s = np.sort(runs[a : b - k + 1])
                new = np.ones(len(s), dtype=bool)
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield s[new]
            else:
                yield _chained(h[a:b], int(b - a)) if b > a else h[:0].copy()
