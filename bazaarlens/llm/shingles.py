"""Word shingles and their min-hash sketches, computed over whole batches of texts with array operations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

from .common import CACHES

__all__ = ["SKETCH", "Words", "mixed", "word_hashes", "shingle_sets", "sketches", "hash_functions", "set_digest"]

SKETCH = 128                     # min-hash values of a sketch
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LETTER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _RNG.integers(1, 2**63, 64, np.uint64) | np.uint64(1)
_SEED = _RNG.integers(1, 2**63, SKETCH, np.uint64) | np.uint64(1)
_SHIFT = _RNG.integers(1, 2**63, SKETCH, np.uint64)
_R = 0x5851F42D4C957F2D
_RI = pow(_R, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
CACHES.append(_powers)


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, 1 << 16), np.uint64(base))
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch of texts: their bytes raw[first:last], text numbers and hashes; ends of the texts in raw."""

    raw: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    total: np.ndarray

    def span_hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the bytes raw[first:last], wherever they stand."""
        h = (self.total[last] - self.total[first]) * _power(_RI, len(self.raw))[first]
        return mixed(h + (last - first).astype(np.uint64))


def word_hashes(texts: list[bytes | None], lower: bool, gap: bytes = b" ") -> Words:
    """Words between white space, hashed from prefix sums over all texts, which ``gap`` (white space) ends; lower: A-Z as a-z."""
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    raw = np.frombuffer(gap.join(t or b"" for t in texts) + gap, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[raw])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    letters = (_LETTER if lower else _BYTE)[raw]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * _power(_R, len(raw)))))
    w = Words(raw, ends, first, last, np.searchsorted(ends, first, side="right"), np.zeros(0, np.uint64), total)
    w.hash = w.span_hash(first, last)
    return w


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``words`` lower-cased (A-Z) words.

    A text of fewer words is one shingle of all of them; a text without words, or null, has none.
    """
    w = word_hashes(texts, lower=True)
    h, counts = w.hash, np.bincount(w.doc, minlength=len(texts))
    n = len(h)
    s = np.zeros(max(n - words + 1, 0), np.uint64)
    for j in range(words):
        s += h[j:n - words + 1 + j] * _PLACE[j] if n >= words else s
    s = mixed(s)
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            out.append(np.unique(s[at:at + c - words + 1]))
        elif c:
            out.append(mixed((h[at:at + c] * _PLACE[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def hash_functions(level: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n hash functions of a level; no two levels share any."""
    rng = np.random.default_rng([20240229, level])
    return rng.integers(1, 2**63, n, np.uint64) | np.uint64(1), rng.integers(1, 2**63, n, np.uint64)


def sketches(sets: list[np.ndarray], functions: tuple[np.ndarray, np.ndarray] = (_SEED, _SHIFT), block: int = 40_000) -> np.ndarray:
    """A row of min-hash values for each set, one a function, of which 16 bits are kept: unlike values agree by chance once
    in 65,536 times, which can only add candidates. Sets must not be empty."""
    seed, shift = functions
    out = np.empty((len(sets), len(seed)), np.uint16)
    a = 0
    while a < len(sets):
        b, size = a + 1, len(sets[a])
        while b < len(sets) and size + len(sets[b]) <= block:
            size += len(sets[b])
            b += 1
        x = np.concatenate(sets[a:b])
        starts = np.concatenate(([0], np.cumsum([len(v) for v in sets[a:b]])[:-1]))
        for j in range(len(seed)):
            least = np.minimum.reduceat(x * seed[j] + shift[j], starts)   # leading bits of a minimum are mostly zero
            out[a:b, j] = mixed(least) & np.uint64(0xFFFF)
        a = b
    return out


def set_digest(values: np.ndarray) -> int:
    """A signed 64-bit integer that names a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(values.tobytes()), "little", signed=True)
