"""Words and shingles of whole Arrow batches in numpy: bytes of many texts are handled at once, never word by word.

Texts are taken as UTF-8; a null text counts as empty. Only A-Z are lower-cased. Words never reach over the end of
a text. Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone and whole.
CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words parted by white space, and bytes of words of letters and digits (all of a non-ASCII character's).
BY_SPACE = ~SPACE
BY_LETTER = np.zeros(256, bool)
BY_LETTER[0x30:0x3A] = BY_LETTER[0x41:0x5B] = BY_LETTER[0x61:0x7B] = BY_LETTER[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_B, _B_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets of each in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES, texts: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes (and so many texts) together, or of one text."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = hi if texts is None else min(hi, lo + texts)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and for each text the number of words before it (one more at the end)."""
    m = is_word[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    first[inner] = m[inner]
    last[inner - 1] = m[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, with A-Z lower-cased. Words are hashed by runs of ``CHUNK_BYTES`` and a longer word in
    pieces, so that a long text needs no more memory than its words do."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, "right")))
        a, z = int(starts[lo]), int(ends[hi - 1])
        if z - a > CHUNK_BYTES:
            out[lo] = _long_word_sum(data[a:z])
        else:
            up, down = _power(z - a + 1)
            sums = np.zeros(z - a + 1, np.uint64)
            np.cumsum(_BYTE[data[a:z]] * up[: z - a], out=sums[1:])
            out[lo:hi] = (sums[ends[lo:hi] - a] - sums[starts[lo:hi] - a]) * down[starts[lo:hi] - a]
        lo = hi
    return mix(out + (ends - starts).astype(np.uint64))


def _long_word_sum(word: np.ndarray) -> np.uint64:
    total, up = 0, _power(CHUNK_BYTES + 1)[0]
    for at in range(0, len(word), CHUNK_BYTES):
        piece = _BYTE[word[at : at + CHUNK_BYTES]]
        total += int((piece * up[: len(piece)]).sum(dtype=np.uint64)) * pow(int(_B), at, 1 << 64)
    return np.uint64(total % (1 << 64))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the number before each text. Fewer than k words, but not none, make one run."""
    n = np.diff(bounds)
    runs = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(runs, out=out_bounds[1:])
    out = np.zeros(out_bounds[-1], np.uint64)
    if len(words) >= k:
        h = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            h = h * _C + words[i : len(words) - k + 1 + i]
        long = n >= k
        at = np.repeat(bounds[:-1][long] - out_bounds[:-1][long], runs[long])
        to = np.flatnonzero(np.repeat(long, runs))
        out[to] = h[to + at]
    for size in range(1, k):
        which = np.flatnonzero(n == size)
        if len(which):
            at = bounds[:-1][which]
            h = words[at].copy()
            for i in range(1, size):
                h = h * _C + words[at + i]
            out[out_bounds[:-1][which]] = h + np.uint64(size * int(_B) % (1 << 64))
    return mix(out), out_bounds


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
