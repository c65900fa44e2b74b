"""Shingle sets, MinHash signatures and the sequential Bayesian test, in numpy.

A document's set holds 64-bit hashes of its distinct shingles. Words are hashed
from the bytes of a whole batch at once; `Signer` turns sets into signatures;
`Pruner` decides from a growing prefix of two signatures whether a pair can still
reach the wanted similarity."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BASE = 0xD6E8FEB86659FD93
_SEGMENT = 2_000_000  # bytes hashed at once; a longer word makes a longer segment
_BLOCK = 32_768  # shingles signed at once
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _hash_segment(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of each word of a piece that cuts no word."""
    word = ~_SPACE[data]
    edges = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    size = 1 << max(21, (len(data) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return starts, _mixed(value + (ends - starts).astype(np.uint64) * _MIX[0])


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(data) <= _SEGMENT:
        return _hash_segment(data)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while end < len(data):  # go on to the next white space
            gap = np.flatnonzero(_SPACE[data[end : end + _SEGMENT]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + _SEGMENT, len(data))
        s, h = _hash_segment(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def word_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all words of consecutive texts, and each text's number of words, for
    as many texts at once as a segment holds. Null texts have no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    gap, row = np.full(1, 32, np.uint8), 0
    while row < len(texts):
        last = int(np.searchsorted(offsets, offsets[row] + _SEGMENT)) - 1
        last = min(max(row + 1, last), len(texts))
        pieces = []
        for r in range(row, last):
            pieces += [data[offsets[r] : offsets[r + 1]] if valid[r] else data[:0], gap]
        starts, hashes = _hash_words(np.concatenate(pieces))
        ends = np.cumsum([len(p) + 1 for p in pieces[::2]])
        yield hashes, np.diff(np.searchsorted(starts, ends), prepend=0)
        row = last


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text
    with fewer than `width` words is one shingle; none, or null, gives no shingle."""
    for hashes, sizes in word_hashes(texts):
        shingles = {}
        for size in range(1, min(width, len(hashes)) + 1):
            n = len(hashes) - size + 1
            mixed = np.full(n, size, np.uint64)
            for i in range(size):
                mixed = _mixed(mixed * _MIX[0] + hashes[i : i + n])
            shingles[size] = mixed
        first = 0
        for count in sizes.tolist():
            size = min(width, count)
            if size:
                yield np.unique(shingles[size][first : first + count - size + 1])
            else:
                yield np.empty(0, np.uint64)
            first += count


@dataclass(frozen=True)
class Signer:
    """Signatures of `bands` x `rows` minima."""

    bands: int
    rows: int
    seed: int = 7

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def sign(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set; the row of an empty set is zero."""
        out = np.zeros((len(sets), self.size), np.uint32)
        filled = [i for i, s in enumerate(sets) if len(s)]
        start = 0
        while start < len(filled):
            end, total = start, 0
            while end < len(filled) and (end == start or total + len(sets[filled[end]]) <= _BLOCK):
                total += len(sets[filled[end]])
                end += 1
            rows = filled[start:end]
            if total <= _BLOCK:
                firsts = np.cumsum([0] + [len(sets[r]) for r in rows[:-1]])
                out[rows] = self._minima(np.concatenate([sets[r] for r in rows]), firsts)
            else:  # one large set, block by block
                blocks = np.split(sets[rows[0]], range(_BLOCK, total, _BLOCK))
                out[rows[0]] = np.min([self._minima(b, np.zeros(1, int))[0] for b in blocks], axis=0)
            start = end
        return out

    def _minima(self, shingles: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        low = shingles.astype(np.uint32)
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        factors = _factors(self.size, self.seed)
        out = np.empty((self.size, len(firsts)), np.uint32)
        value = np.empty_like(low)
        for k in range(self.size):
            np.multiply(low, factors[k], out=value)
            np.add(value, high, out=value)
            np.minimum.reduceat(value, firsts, out=out[k])
        return out.T

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key per signature row and band; keys of two bands differ."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2])
        for i in range(self.rows):
            key = _mixed(key * _MIX[0] + parts[:, :, i])
        return key.astype(np.int64)


@lru_cache(maxsize=4)
def _factors(size: int, seed: int) -> np.ndarray:
    drawn = np.random.default_rng(seed).integers(0, 2**32, size, dtype=np.uint64)
    return drawn.astype(np.uint32) | np.uint32(1)


@dataclass(frozen=True)
class Pruner:
    """Sequential test of pairs: after each batch of minima the posterior of the
    similarity, from a uniform prior, must still give the wanted similarity a
    probability of at least `miss`."""

    threshold: float
    size: int
    batch: int = 20
    miss: float = 1e-5

    def least_matches(self) -> list[tuple[int, int]]:
        """(minima compared, matches a pair needs to stay)."""
        return _least_matches(self)

    def survivors(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the row pairs that stay, and their shares of equal minima.
        One of the two may be a single row."""
        count = max(len(left), len(right))
        alive, matches, done = np.arange(count), np.zeros(count, np.int32), 0
        for upto, least in self.least_matches():
            a = left[:, done:upto] if len(left) == 1 < count else left[alive, done:upto]
            b = right[:, done:upto] if len(right) == 1 < count else right[alive, done:upto]
            matches = matches + (a == b).sum(axis=1, dtype=np.int32)
            stay = matches >= least
            alive, matches, done = alive[stay], matches[stay], upto
            if not len(alive):
                break
        return alive, matches / max(done, 1)


@lru_cache(maxsize=8)
def _least_matches(p: Pruner) -> list[tuple[int, int]]:
    grid = (np.arange(4000) + 0.5) / 4000
    above = grid >= p.threshold
    out = []
    for n in range(p.batch, p.size + 1, p.batch):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[above].sum() / weight.sum() >= p.miss:
                break
        out.append((n, m))
    return out
