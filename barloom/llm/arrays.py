"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a longest run of bytes other than space and \\t \\n \\v \\f \\r (none of which occurs within a longer UTF-8
character). Word hashes are 64-bit polynomials in wrapping arithmetic over random byte values, finished by a mixer;
a running sum of the weighted bytes gives the hash of any run of bytes by one subtraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEPARATORS = b" \t\n\v\f\r"
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(_SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 3
_INVERSE = pow(_BASE, -1, 2**64)
_SLICE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_tables.get("up", ())) < n:
        size = max(n, _SLICE + 4096)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["up"][:n], _tables["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of width values; len(values) - width + 1 of them."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _SLICE):
        part = values[a : min(a + _SLICE, n) + width - 1]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - width + 1
        out[a : a + m] = (total[width:] - total[:m]) * down[:m]
    return mix(out)


class Words:
    """The words of a batch of texts (null: no words).

    data: bytes; starts, ends: each word's place in data; bounds: the first word of each text, and the number of words.
    is_word: which of the 256 bytes belong to words, if not those above.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False, is_word: np.ndarray = _IS_WORD):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null(b"")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2], np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
        offsets = offsets - lo
        self.data = _LOWER[data] if lower else data
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = is_word[data]
        begin = word[1:-1] & ~word[:-2]
        end = word[1:-1] & ~word[2:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begin[edges] = word[1:-1][edges]
        end[edges - 1] = word[1:-1][edges - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def _slices(self):
        """Pieces of words whose bytes take about _SLICE."""
        a = 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + _SLICE, "right")))
            yield a, b
            a = b

    def hashes(self, *parts) -> np.ndarray | list[np.ndarray]:
        """Hash of every word. With parts, functions from (starts, ends) to (starts, ends), a list with one array each."""
        whole = parts or (lambda s, e: (s, e),)
        out = [np.empty(len(self), np.uint64) for _ in whole]
        for a, b in self._slices():
            lo, hi = self.starts[a], self.ends[b - 1]
            up, down = powers(hi - lo + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[self.data[lo:hi]] * up[: hi - lo], out=total[1:])
            for k, part in enumerate(whole):
                s, e = part(self.starts[a:b] - lo, self.ends[a:b] - lo)
                out[k][a:b] = mix((total[e] - total[s]) * down[s])
        return out if parts else out[0]

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run: for lengths 2, 3 the array 0 1 0 1 2."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
