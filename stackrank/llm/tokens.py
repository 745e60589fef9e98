"""Tokenising with a cache of pieces.

A public tokenizer file encodes a text as the concatenation of its pre-tokens, so a
text can be cut wherever a pre-token must end, and pieces seen before need not be
encoded again. Pieces are found, hashed and looked up for a whole batch of bytes by
array operations; only new pieces become Python strings. Cuts used here:

* byte-level files (GPT-2 pattern): before a single space that follows a non-space, and
  around a line feed between non-spaces; texts with other runs of white space or
  control characters are encoded whole;
* word files that drop white space: at spaces, tabs and line ends;
* both: between an ASCII letter or digit and the punctuation behind it.

A text that may hold an added token such as ``<|endoftext|>`` (which the library, at its
defaults, gives an id of its own) is encoded whole. A piece is known by a 64-bit hash of its
bytes under a key that each worker process draws for itself, so that no text can be made
whose pieces collide; pieces of more than 64 bytes by keyed BLAKE2b. ``tests/llm`` compare
the ids with whole-text encoding by an unchanged ``Tokenizer``.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from stackrank.llm.wordhash import U, mix, span_hashes, text_buffer

_KIND = (U(0x51ED2701A3C5E9B7), U(0xD6E8FEB86659FD93))     # without and with a space before


def _bytes(*chars: int) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_ENDING = _bytes(*b".,;:!?*%$&#")                 # never part of a contraction or of a word
_ALNUM = _bytes(*range(48, 58), *range(65, 91), *range(97, 123))
_CONTROL = _bytes(*range(10), *range(11, 32), 127)
_BREAK = _bytes(32, 10, 9, 13)
_WIDE = _bytes(0xC2, 0xE1, 0xE2, 0xE3)            # first bytes of white space beyond ASCII
_WIDE_SPACE = [c.encode() for c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
                                             0x2029, 0x202F, 0x205F, 0x3000))]


class HashTable:
    """uint64 -> consecutive numbers, looked up by arrays (open addressing)."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.vals = np.zeros(1 << bits, np.int32)

    def _slot(self, h):
        return (h >> U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 if unknown."""
        out = np.full(len(h), -1, np.int64)
        left, slot, mask = np.arange(len(h)), self._slot(h), (1 << self.bits) - 1
        while len(left):
            k = self.keys[slot]
            hit = k == h[left]
            out[left[hit]] = self.vals[slot[hit]]
            on = ~hit & (k != 0)
            left, slot = left[on], (slot[on] + 1) & mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Number new distinct hashes in order; at most half of the slots are used."""
        if 2 * (self.n + len(h)) > len(self.keys):
            used = np.flatnonzero(self.keys)
            old, number = self.keys[used], self.vals[used]
            self.bits = (2 * (self.n + len(h))).bit_length() + 1
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.vals = np.zeros(1 << self.bits, np.int32)
            self._put(old, number)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h, number):
        left, slot, mask = np.arange(len(h)), self._slot(h), (1 << self.bits) - 1
        while len(left):
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]] = h[left[put]]
            self.vals[slot[put]] = number[left[put]]
            on = np.ones(len(left), bool)
            on[put] = False
            left, slot = left[on], (slot[on] + 1) & mask


class PieceEncoder:
    """Encodes texts with a ``tokenizers`` JSON file. Beyond ``max_pieces`` pieces the less
    used half is forgotten, so memory is bounded."""

    def __init__(self, path: str, max_pieces: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.drops_space = json.load(f).get("normalizer") is not None
        self.sep = " \x1f " if self.drops_space else "\n"
        (self.sep_id,) = self.tok.encode(self.sep, add_special_tokens=False).ids
        self.max_pieces = max_pieces
        self.key = U(int.from_bytes(os.urandom(8), "little"))
        self.mark = b"<|"                  # how the added tokens of the files begin
        self.bits = max(10, (4 * max_pieces).bit_length() - 1)
        self._reset()

    def _reset(self):
        self.table = HashTable(self.bits)
        self.hash = np.zeros(0, np.uint64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.off = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _plain(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Whether each text can be cut into pieces."""
        ok = np.ones(len(offs) - 1, bool)
        if not len(data):
            return ok
        marked = np.flatnonzero((data[:-1] == self.mark[0]) & (data[1:] == self.mark[1]))
        ok[np.searchsorted(offs, marked, "right") - 1] = False
        if self.drops_space:
            return ok
        space, feed = data == 32, data == 10
        white = space | feed
        bad = _CONTROL[data]
        bad[:-1] |= white[:-1] & white[1:]
        filled = offs[1:] > offs[:-1]
        bad[offs[:-1][filled]] |= white[offs[:-1][filled]]
        bad[offs[1:][filled] - 1] |= space[offs[1:][filled] - 1]
        wide = np.flatnonzero(_WIDE[data])
        if len(wide):
            raw = data.tobytes()
            pairs = data[np.minimum(wide + 1, len(data) - 1)]
            wide = wide[(data[wide] != 0xC2) | (pairs == 0x85) | (pairs == 0xA0)]
            for i in wide.tolist():
                if raw[i:i + 2] in _WIDE_SPACE or raw[i:i + 3] in _WIDE_SPACE:
                    bad[i] = True
        ok[np.searchsorted(offs, np.flatnonzero(bad), "right") - 1] = False
        return ok

    def _pieces(self, data, offs):
        """(starts, ends, whether a space comes before) of the pieces of all texts."""
        gap = _BREAK[data] if self.drops_space else data == 32
        feed = np.zeros(len(data), bool) if self.drops_space else data == 10
        solid = ~gap
        first = solid.copy()
        first[1:] &= gap[:-1] | feed[:-1] | feed[1:] | (_ENDING[data[1:]] & _ALNUM[data[:-1]])
        begin = offs[:-1][offs[:-1] < len(data)]
        first[begin] = solid[begin]
        starts = np.flatnonzero(first)
        stop = np.zeros(len(data) + 1, bool)
        stop[starts] = True
        stop[np.flatnonzero(gap)] = True
        stop[offs] = True
        stop[-1] = True
        where = np.flatnonzero(stop)
        ends = where[np.searchsorted(where, starts, "right")]
        spaced = np.zeros(len(starts), bool)
        if not self.drops_space:
            inner = starts > 0
            spaced[inner] = gap[starts[inner] - 1]
            at = np.searchsorted(starts, begin)
            at = at[at < len(starts)]
            spaced[at[np.isin(starts[at], begin)]] = False
        return starts, ends, spaced

    def _encode_plain(self, data, offs):
        if self.table.n > self.max_pieces:
            self._shrink()
        starts, ends, spaced = self._pieces(data, offs)
        counts = np.diff(np.searchsorted(starts, offs))
        lens = ends - starts
        if not len(lens):
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        h = span_hashes(data, starts, ends, self.key)
        h = mix(h ^ np.where(spaced, _KIND[1], _KIND[0])) | U(1)
        idx = self.table.find(h)
        new = np.flatnonzero(idx < 0)
        if len(new):
            _, one = np.unique(h[new], return_index=True)
            one = new[one]
            raw = data.tobytes()
            self._learn(h[one], [(" " if s else "") + raw[a:b].decode() for a, b, s in
                                 zip(starts[one].tolist(), ends[one].tolist(),
                                     spaced[one].tolist())])
            idx[new] = self.table.find(h[new])
        self.uses += np.bincount(idx, minlength=len(self.uses))
        cum = np.concatenate([[0], np.cumsum(self.len[idx])])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return self._gather(idx), cum[edges[1:]] - cum[edges[:-1]]

    def _learn(self, hashes, strings):
        """Encode new pieces; words many at a time, joined by a pre-token of one id that
        none of them holds."""
        word = np.array([s.lstrip(" ").isalpha() for s in strings], bool)
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        n = int(word.sum())
        easy = [strings[i] for i in order[:n].tolist()]
        runs = [self.sep.join(easy[i:i + 64]) for i in range(0, n, 64)]
        ids = np.fromiter(chain.from_iterable(
            chain(e.ids, (self.sep_id,))
            for e in self.tok.encode_batch_fast(runs, add_special_tokens=False)), np.uint32)
        is_sep = ids == self.sep_id
        lens = np.diff(np.flatnonzero(is_sep), prepend=-1) - 1
        rest = [e.ids for e in self.tok.encode_batch_fast(
            [strings[i] for i in order[n:].tolist()], add_special_tokens=False)]
        more = np.fromiter(map(len, rest), np.int64, len(rest))
        ids = np.concatenate([ids[~is_sep], np.fromiter(chain.from_iterable(rest), np.uint32)])
        lens = np.concatenate([lens, more])
        total = len(ids)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate(
                [self.flat, np.zeros(max(len(self.flat), total), np.uint32)])
        self.flat[self.used:self.used + total] = ids
        self.table.add(hashes[order])
        self.hash = np.concatenate([self.hash, hashes[order]])
        self.off = np.concatenate([self.off, self.used + np.cumsum(lens) - lens])
        self.len = np.concatenate([self.len, lens])
        self.uses = np.concatenate([self.uses, np.zeros(len(lens), np.int64)])
        self.used += total

    def _gather(self, idx):
        """Ids of the pieces ``idx`` one after the other."""
        lens = self.len[idx]
        ends = np.cumsum(lens)
        where = np.repeat(self.off[idx] - (ends - lens), lens)
        where += np.arange(len(where))
        return self.flat[where]

    def _shrink(self):
        """Keep the more used half of the pieces."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:self.max_pieces // 2])
        hashes, lens, ids = self.hash[keep], self.len[keep], self._gather(keep)
        self._reset()
        self.table.add(hashes)
        self.hash, self.len, self.off = hashes, lens, np.cumsum(lens) - lens
        self.used = len(ids)
        self.flat = np.concatenate([ids, np.zeros(1 << 16, np.uint32)])
        self.uses = np.zeros(len(keep), np.int64)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, number of ids of each text). ``texts`` is an Arrow
        string array or a list; null is empty."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        data, offs = text_buffer(col)
        plain = self._plain(data, offs)
        if plain.all():
            return self._encode_plain(data, offs)
        odd = np.flatnonzero(~plain)
        some = text_buffer(col.filter(pa.array(plain)))
        ids, lens = self._encode_plain(*some)
        whole = self.tok.encode_batch_fast(col.take(pa.array(odd)).to_pylist(),
                                           add_special_tokens=False)
        parts: list = [None] * len(plain)
        for i, x in zip(np.flatnonzero(plain).tolist(), np.split(ids, np.cumsum(lens)[:-1])):
            parts[i] = x
        for i, e in zip(odd.tolist(), whole):
            parts[i] = np.array(e.ids, np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


_CACHE: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    if path not in _CACHE:
        _CACHE[path] = PieceEncoder(path)
    return _CACHE[path]


def with_end(ids: np.ndarray, lens: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every text."""
    out = np.empty(len(ids) + len(lens), np.uint32)
    last = np.cumsum(lens + 1) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[last] = end_id
    out[keep] = ids
    return out, lens + 1


def crc32s(ids: np.ndarray, lens: np.ndarray) -> list:
    """Unsigned crc32 of each run of ids as little-endian 32-bit integers."""
    import zlib
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    ends = np.cumsum(lens) * 4
    return [zlib.crc32(raw[b:e]) for b, e in zip((ends - lens * 4).tolist(), ends.tolist())]
