"""Words and word n-grams of whole Arrow batches as 64-bit hashes, without Python
objects per word.

A word is a run of digits, letters a-z (A-Z lower-cased) and characters beyond
ASCII, i.e. ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. In UTF-8
all bytes from 0x80 on belong to such characters, so bytes can be classed by a table.
A word's hash takes eight bytes at a time through a bit mixer (a bijection of 64 bits that
is not linear), so no family of words collides by its structure; words of more than 64
bytes are hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240601))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32                                   # A-Z as a-z
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_LENGTH, _NEXT = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG = 64                                            # bytes of a word hashed eight at a time
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer (multiply and xor-shift) on uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as little-endian integers (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed=_LENGTH,
                window: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte ranges; ``window`` is ``eights(data)`` if it is at hand."""
    lens = ends - starts
    if not len(lens):
        return np.zeros(0, np.uint64)
    u = eights(data) if window is None else window
    h = mix((u[starts] & LOW_BYTES[np.minimum(lens, 8)]) ^ mix(lens.astype(np.uint64) + seed))
    at, done = np.flatnonzero((lens > 8) & (lens <= LONG)), 8
    while len(at):
        part = u[starts[at] + done] & LOW_BYTES[np.minimum(lens[at] - done, 8)]
        h[at] = mix(h[at] ^ mix(part + _NEXT))
        done += 8
        at = at[lens[at] > done]
    key = int(seed).to_bytes(8, "little")
    for i in np.flatnonzero(lens > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, key=key)
        h[i] = int.from_bytes(digest.digest(), "little")
    return h


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    _, off, data = col.buffers()
    offs = np.frombuffer(off, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64) \
        if off is not None else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges [start, end) of the words; no word crosses a text's edge."""
    w = _IS_WORD[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    edges = offs[:-1][offs[:-1] < len(data)]
    first[edges] = w[edges]
    starts = np.flatnonzero(first)
    last = w.copy()
    last[:-1] &= ~w[1:]
    edges = offs[1:][offs[1:] > 0] - 1
    last[edges] = w[edges]
    return starts, np.flatnonzero(last) + 1


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    data, offs = text_buffer(col)
    starts, ends = word_spans(data, offs)
    edge = np.searchsorted(starts, offs)
    return span_hashes(LOWER[data], starts, ends), np.diff(edge)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (over the whole array; callers mask text edges)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j:j + n] * _GRAM[j]
    return mix(out + U(k))


def inside(counts: np.ndarray, k: int) -> np.ndarray:
    """Positions whose run of ``k`` words stays in one text (indices into ``grams``)."""
    total = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    pos = np.arange(total)
    return pos[pos + k <= ends]


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, k: int) -> list:
    """Sorted distinct shingles of each text; a text of 1 to k-1 words is one shingle."""
    ends = np.cumsum(counts)
    g = grams(hashes, k)
    out = []
    for n, e in zip(counts.tolist(), ends.tolist()):
        if n >= k:
            out.append(np.unique(g[e - n:e - k + 1]))
        elif n:
            out.append(grams(hashes[e - n:e], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
