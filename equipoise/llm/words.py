"""Vectorised words and hashes of whole texts, for use inside tasks.

A batch of texts (an Arrow string array) is handled as one byte array: A-Z are lower-cased by a table, words
are the runs between the six ASCII white-space bytes, and all words are hashed at once by a polynomial over
random byte values modulo 2**64, taken from prefix sums, and mixed.  Long batches are worked off in stretches
of ``STRETCH`` bytes that end between words: a stretch and its tables of powers take some 50 bytes a byte, so memory
follows the longest word, not the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

STRETCH = 1 << 18
_rng = np.random.default_rng(20240229)
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


@dataclass
class Words:
    """Words of a batch in order: hash, hash of the first bytes (if asked for), and each text's first word (n + 1 bounds)."""

    hashes: np.ndarray
    bounds: np.ndarray
    heads: np.ndarray | None = None


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``texts`` (NULL: none) and the n + 1 bounds of each text in them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def words_of(texts: pa.Array, space: np.ndarray = SPACE, head: int = 0) -> Words:
    """Words of ``texts`` between the bytes marked in ``space`` (256 flags); ``head``: also hash their first bytes."""
    raw, bounds = text_bytes(texts)
    inner = np.unique(bounds[1:-1])
    inner = inner[inner < len(raw)]
    space = space[raw]
    opens = ~space
    opens[1:] &= space[:-1]
    opens[inner] = ~space[inner]  # a text's first byte begins a word whatever precedes it
    starts = np.flatnonzero(opens)
    last = ~space
    last[:-1] &= space[1:]
    before = inner[inner > 0] - 1
    last[before] = ~space[before]
    ends = np.flatnonzero(last) + 1
    del space, opens, last
    hashes = np.empty(len(starts), np.uint64)
    heads = np.empty(len(starts), np.uint64) if head else None
    at = 0
    inverse = pow(_BASE, -1, 1 << 64)
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH, side="right")))
        lo, hi = int(starts[at]), int(ends[upto - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUE[raw[lo:hi]] * _power(_BASE, hi - lo), out=sums[1:])
        s, e = starts[at:upto] - lo, ends[at:upto] - lo
        scale = _power(inverse, hi - lo)[s]
        hashes[at:upto] = mix64((sums[e] - sums[s]) * scale + (e - s).astype(np.uint64))
        if heads is not None:
            heads[at:upto] = mix64((sums[np.minimum(e, s + head)] - sums[s]) * scale)
        at = upto
    return Words(hashes, np.searchsorted(starts, bounds).astype(np.int64), heads)
