"""Vectorised text primitives shared by the operators that run numpy over Arrow batches.

Every function works on a *chunk*: the UTF-8 bytes of a bounded number of whole
documents, concatenated, with their offsets.  Nothing is ever cut from a document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One random odd 64-bit value for each byte: keeps polynomial hashes free of byte-value structure.
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if n > CHUNK_BYTES + 1024:  # for one long text: not kept
        return _accumulated(_BASE, n), _accumulated(_BASE_INV, n)
    if not _powers:
        _powers.update(p=_accumulated(_BASE, CHUNK_BYTES + 1024), i=_accumulated(_BASE_INV, CHUNK_BYTES + 1024))
    return _powers["p"][:n], _powers["i"][:n]


def _accumulated(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def give_back() -> None:
    """Returns freed memory to the system where the C library can: workers stay from one step to the next."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def text_array(column) -> pa.Array:
    """One contiguous large_string array; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole documents of about `limit` bytes."""
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b
    give_back()


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words `[^\\x20\\x09-\\x0D]+`, and for each document the index of its first word (n + 1 values)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~_SPACE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: polynomial prefix sums, then a finaliser that also takes the length."""
    p, inv = powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | U(1)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles of each document, in order, with their offsets.

    A document with 1 to k-1 words has its whole sequence as its only shingle; one without words has none.
    """
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    out = np.empty(offs[-1], np.uint64)
    if len(words) >= k:
        full = words[: len(words) - k + 1] * _PLACE[0]
        for j in range(1, k):
            full = full + words[j : len(words) - k + 1 + j] * _PLACE[j]
        at = np.arange(offs[-1]) - np.repeat(offs[:-1], made) + np.repeat(first[:-1], made)
        long = np.repeat(count >= k, made)
        out[long] = mix(full[at[long]] + U(k))
    for d in np.flatnonzero((count > 0) & (count < k)):
        w = words[first[d] : first[d + 1]]
        out[offs[d]] = mix(np.array([(w * _PLACE[: len(w)]).sum() + U(len(w))], np.uint64))[0]
    return out, offs


def word_shingles(texts: pa.Array, k: int, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, shingle hashes, offsets) chunk by chunk."""
    for a, _, raw, offs in chunks(texts):
        raw = lower_ascii(raw) if lower else raw
        s, e, first = word_spans(raw, offs)
        yield a, *shingles(span_hashes(raw, s, e), first, k)
