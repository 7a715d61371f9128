"""Vectorised scanning of Arrow text columns: word spans, word hashes and rolling hashes of word n-grams.

Hashes are polynomials modulo 2**64 over mixed bytes, from prefix sums, so a pass costs a few nanoseconds a byte. Equal words
have equal hashes, but unequal ones may have too (self-similar words over two letters do by construction). So hashes only
choose: anchors and index terms, whose words are compared before anything is found or removed, and buckets of counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 20
_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Only space and \t \n \v \f \r part words.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits parts words.
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER_BYTES = BYTES.copy()
LOWER_BYTES[65:91] = BYTES[97:123]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        n = max(n, _BLOCK + 1)
        inverse = np.uint64(pow(int(base), -1, 2**64))
        got = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, dtype=np.uint64))]) for b in (base, inverse))
        _powers[int(base)] = got
    return got


def spans(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a word never crosses one of the bounds (offsets at which documents start)."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = ~apart[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = BYTES) -> np.ndarray:
    out = np.empty(len(start), dtype=np.uint64)
    up, down = powers(_BASE, _BLOCK + 1)
    i = 0
    while i < len(start):
        at = start[i]
        j = int(np.searchsorted(end, at + _BLOCK, "right"))
        if j <= i:  # one word longer than a block
            out[i] = int.from_bytes(hashlib.blake2b(values[data[at : end[i]]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        n = int(end[j - 1] - at)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[data[at : at + n]] * up[:n], out=total[1:])
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; documents are not told apart here."""
    m = len(words)
    if m < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(_GRAM, m + 1)
    total = np.zeros(m + 1, dtype=np.uint64)
    np.cumsum(words * up[:m], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: m - n + 1])


def texts(batch: pa.RecordBatch, name: str = "text", most: int = 2 << 20):
    """(first row, end row, bytes, offsets) of runs of rows with at most `most` bytes, or of one longer row. Null is empty."""
    col = batch.column(name)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, off, raw = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
