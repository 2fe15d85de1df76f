"""Word shingles and circulant MinHash over whole Arrow text columns, in NumPy.

Words are maximal runs of bytes outside white space; in UTF-8 all of its bytes
are ASCII, so words can be cut in bytes. A word's hash is a polynomial over its
bytes, taken from running sums over many texts at once.
"""

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"
WIDTH = 5

_rng = np.random.Generator(np.random.PCG64(20240601))
_ODD = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _ODD(256)
_PLACE = _ODD(WIDTH)
_BASE = int(_ODD(1)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that share one running sum; a longer text has a sum of its own.
CHUNK = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, np.uint64(base), np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without nulls."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if "large" in str(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Ranges of rows with about ``size`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes that hold texts between ``bounds``."""
    inside = ~_IS_SPACE[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_words(column, lower: bool = True):
    """Yields (first row, words' row numbers from there, hashes, rows) for runs of an Arrow string column."""
    raw, offsets = text_buffers(column)
    for lo, hi in chunks(offsets):
        at = offsets[lo]
        part = raw[at : offsets[hi]]
        if lower:
            part = _LOWER[part]
        bounds = offsets[lo : hi + 1] - at
        starts, ends = word_spans(part, bounds)
        yield lo, np.searchsorted(bounds, starts, side="right") - 1, word_hashes(part, starts, ends), hi - lo


def shingle_sets(column):
    """Yields, per text, the sorted distinct hashes of its 5-word shingles; of its whole word sequence if it has fewer words."""
    for _, row, words, rows in text_words(column):
        ends = np.searchsorted(row, np.arange(rows), side="right")
        total = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
        for k in range(WIDTH):
            total += words[k : k + len(total)] * _PLACE[k]
        grams, lo = mix(total), 0
        for hi in ends.tolist():
            n = hi - lo
            if n >= WIDTH:
                yield np.unique(grams[lo : hi - WIDTH + 1])
            elif n:
                yield mix((words[lo:hi] * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
            lo = hi


class Circulant:
    """Signatures from two permutations: the first scatters the shingles, the second, shifted by k, gives coordinate k."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.size = bands, rows, bands * rows

    @staticmethod
    def _scatter(sets: np.ndarray) -> np.ndarray:
        return (mix(sets ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """(texts, size) of unsigned 32-bit minima; the texts' sets are not empty."""
        out = np.empty((len(sets), self.size), np.uint32)
        lo = 0
        while lo < len(sets):  # runs of sets that fit a core's cache
            hi, n = lo + 1, len(sets[lo])
            while hi < len(sets) and n + len(sets[hi]) <= 32_768:
                n += len(sets[hi])
                hi += 1
            x = self._scatter(np.concatenate(sets[lo:hi]))
            at = np.r_[0, np.cumsum([len(s) for s in sets[lo : hi - 1]])].astype(np.intp)
            y, z = np.empty_like(x), np.empty_like(x)
            for k in range(self.size):
                np.add(x, np.uint32(k), out=y)  # the shift; addition wraps round
                np.multiply(y, np.uint32(0x9E3779B1), out=y)
                np.right_shift(y, np.uint32(15), out=z)
                np.bitwise_xor(y, z, out=y)
                np.multiply(y, np.uint32(0x85EBCA77), out=y)
                out[lo:hi, k] = np.minimum.reduceat(y, at)
            lo = hi
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """(texts, bands) of 64-bit keys that differ from band to band."""
        s = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        key = np.arange(self.bands, dtype=np.uint64)[None, :] + np.uint64(1)
        for k in range(self.rows):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + s[:, :, k])
        return key.view(np.int64)
