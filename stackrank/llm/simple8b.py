"""Token ids as Simple-8b files: word-aligned coding of ids in 64-bit words.

Every word has a 4-bit selector on top and 60 bits of payload. Selectors 1 to 14
hold ``count`` values of ``width`` bits (count * width <= 60), selector 15 stands for
120 zeros, and selector 0 is the escape: it carries the top 4 bits of the next
value, which follows in a word of its own (selector 14, 60 bits), so that any
unsigned 64-bit value can be written and each word can be read by its selector alone.

Values are coded in blocks of 4096, each starting at a word of its own; the file
keeps the word offset of each block, so any block can be decoded alone and all
blocks of a file at once, without a loop over values.

File (little-endian): magic ``S8B1``, words, block offsets (uint64, one more than
blocks), document table (int64 id, int64 count of ids; a null doc_id is marked in
a byte table), then a trailer with the counts and the magic again.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackrank.llm.common import open_fs, range_shards, shared_folder, slices, written
from stackrank.llm.tokens import encoder, with_end

MAGIC = b"S8B1"
BLOCK = 4096
ESCAPE, ZEROS = 0, 15
# fixed values of the format: (selector, values in a word, bits of a value)
LAYOUTS = [(1, 60, 1), (2, 30, 2), (3, 20, 3), (4, 15, 4), (5, 12, 5), (6, 10, 6), (7, 8, 7),
           (8, 7, 8), (9, 6, 10), (10, 5, 12), (11, 4, 15), (12, 3, 20), (13, 2, 30),
           (14, 1, 60)]
COUNT = np.zeros(16, np.int64)
for _s, _n, _w in LAYOUTS:
    COUNT[_s] = _n
COUNT[ZEROS] = 120
_PAD = 120
_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def encode_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word count of each block of 4096 values); the last block may be short."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    v = np.zeros((blocks, BLOCK + _PAD), values.dtype)
    whole = n // BLOCK
    v[:whole, :BLOCK] = values[:whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        v[whole, :n - whole * BLOCK] = values[whole * BLOCK:]
    bits = _bit_length(v)
    # the longest run that fits a layout, as sliding maxima of bit lengths
    top = {1: bits}

    def runs(k):
        if k not in top:
            half = k // 2 if k > 8 else 1
            a, b = runs(half), runs(k - half)
            out = a.copy()
            np.maximum(out[:, :-half], b[:, half:], out=out[:, :-half])
            top[k] = out
        return top[k]

    choice = np.full(bits.shape, 14, np.uint8)
    for s, count, width in reversed(LAYOUTS[:-1]):
        np.copyto(choice, s, where=runs(count) <= width)
    np.copyto(choice, ZEROS, where=runs(120) == 0)
    width_of = np.full(blocks, BLOCK, np.int64)
    width_of[-1] = n - (blocks - 1) * BLOCK
    row = v.shape[1]
    base = np.arange(blocks) * row
    pos = np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    ch = choice.ravel()
    at, of, sel = [], [], []
    while len(live):
        p = base[live] + pos[live]
        s = ch[p]
        at.append(p)
        of.append(live)
        sel.append(s)
        pos[live] += COUNT[s]
        live = live[pos[live] < width_of[live]]
    at, of, sel = np.concatenate(at), np.concatenate(of), np.concatenate(sel)
    order = np.argsort(at)
    at, of, sel = at[order], of[order], sel[order]
    vf = v.ravel()
    words = np.zeros(len(at), np.uint64)
    for s, count, width in LAYOUTS:
        m = np.flatnonzero(sel == s)
        if len(m):
            block = vf[at[m][:, None] + np.arange(count)].astype(np.uint64)
            words[m] = np.bitwise_or.reduce(
                block << (np.arange(count, dtype=np.uint64) * np.uint64(width)), axis=1)
    high = np.zeros(len(at), bool)
    big = sel == 14
    high[big] = bits.ravel()[at[big]] > 60
    words &= np.uint64((1 << 60) - 1)
    words |= sel.astype(np.uint64) << np.uint64(60)
    if high.any():
        where = np.flatnonzero(high)
        words = np.insert(words, where, vf[at[where]].astype(np.uint64) >> np.uint64(60))
        of = np.insert(of, where, of[where])
    return words, np.bincount(of, minlength=blocks)


def _bit_length(v: np.ndarray) -> np.ndarray:
    """Bits of each unsigned value, as uint8."""
    if v.max(initial=0) < len(_BITS):
        return _BITS[v]
    if v.max(initial=0) < 1 << 32:
        return np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    high = (v >> np.uint64(32)).astype(np.float64)
    low = (v & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def decode_blocks(words: np.ndarray, word_counts: np.ndarray, total: int) -> np.ndarray:
    """Values of consecutive blocks; ``total`` counts them (only the last may be short)."""
    sel = (words >> np.uint64(60)).astype(np.uint8)
    load = words & np.uint64((1 << 60) - 1)
    size = COUNT[sel]
    ends = np.cumsum(size)
    starts = ends - size
    block_of = np.repeat(np.arange(len(word_counts)), word_counts)
    first = np.cumsum(word_counts) - word_counts
    # a block's last word may stand for more values than the block has
    starts = starts - starts[first][block_of] + block_of * BLOCK if len(words) else starts
    out = np.zeros(len(word_counts) * BLOCK + _PAD, np.uint64)
    for s, count, width in LAYOUTS:
        m = np.flatnonzero(sel == s)
        if len(m):
            vals = (load[m][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))
                    ) & np.uint64((1 << width) - 1)
            where = starts[m][:, None] + np.arange(count)
            inside = where < (block_of[m][:, None] + 1) * BLOCK
            out[where[inside]] = vals[inside]
    esc = np.flatnonzero(sel == ESCAPE)
    if len(esc):
        out[starts[esc]] |= load[esc] << np.uint64(60)
    return out[:total]


class Writer:
    """Streams (doc_id, ids) into one file; memory is one run of documents."""

    def __init__(self, sink):
        self.sink, self.rest = sink, np.zeros(0, np.uint32)
        self.offsets, self.ids, self.null, self.counts = [0], [], [], []
        self.words = self.total = 0
        sink.write(MAGIC)

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray):
        self.ids += [0 if d is None else d for d in doc_ids]
        self.null += [d is None for d in doc_ids]
        self.counts += counts.tolist()
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // BLOCK * BLOCK
        self._put(ids[:full])
        self.rest = ids[full:]

    def _put(self, values):
        words, counts = encode_blocks(values)
        self.sink.write(words.astype("<u8").tobytes())
        for c in counts.tolist():
            self.words += c
            self.offsets.append(self.words)

    def close(self):
        self._put(self.rest)
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(np.array(self.ids, "<i8").tobytes())
        self.sink.write(np.array(self.counts, "<i8").tobytes())
        self.sink.write(np.array(self.null, "u1").tobytes())
        self.sink.write(struct.pack("<QQQQ4s", self.words, len(self.offsets), len(self.ids),
                                    self.total, MAGIC))


TRAILER = struct.calcsize("<QQQQ4s")


def read_file(f, blocks_at_once: int = 128):
    """Yield (doc_id or None, ids before it in the file, count, crc32) of an open file.
    Decodes ``blocks_at_once`` blocks at a time, so a long document needs no more memory."""
    end = f.size()
    f.seek(end - TRAILER)
    n_words, n_off, n_docs, total, magic = struct.unpack("<QQQQ4s", f.read(TRAILER))
    if magic != MAGIC:
        raise ValueError("not a Simple-8b token file")
    f.seek(4 + 8 * n_words)
    offsets = np.frombuffer(f.read(8 * n_off), "<u8").astype(np.int64)
    ids = np.frombuffer(f.read(8 * n_docs), "<i8")
    counts = np.frombuffer(f.read(8 * n_docs), "<i8")
    null = np.frombuffer(f.read(n_docs), "u1")
    starts = np.cumsum(counts) - counts
    doc, crc, left = 0, 0, int(counts[0]) if n_docs else 0
    f.seek(4)
    for b in range(0, n_off - 1, blocks_at_once):
        e = min(b + blocks_at_once, n_off - 1)
        words = np.frombuffer(f.read(8 * int(offsets[e] - offsets[b])), "<u8")
        vals = decode_blocks(words, np.diff(offsets[b:e + 1]),
                             min(total - b * BLOCK, (e - b) * BLOCK)).astype("<u4")
        raw, at = memoryview(vals).cast("B"), 0
        while at < len(vals):
            take = min(left, len(vals) - at)
            crc = zlib.crc32(raw[4 * at:4 * (at + take)], crc)
            at += take
            left -= take
            while left == 0:
                yield (None if null[doc] else int(ids[doc])), int(starts[doc]), \
                    int(counts[doc]), crc
                doc, crc = doc + 1, 0
                if doc == n_docs:
                    break
                left = int(counts[doc])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text",
                      shard_bytes: int = 32 << 20) -> DataFrame:
    """Write the ids of every document to Simple-8b files below ``folder`` in ascending
    order of ``id_col`` and return the manifest: shard, file, n_docs, n_ids.

    The documents are range-placed once (exact placement by split points of the
    ids); each task streams its shard into one file under a temporary name, then
    renames it, so a repeated task leaves the same file. Null texts have the end id
    alone; null ids come first; rows that repeat an id are all written, in order of
    their text. Other columns are ignored. An empty table writes no file.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    placed, _ = range_shards(slim, "_id", F.coalesce(F.octet_length("_text"), F.lit(0)) + 1,
                             shard_bytes, [F.xxhash64("_text")])

    def run(batches):
        from pyspark import TaskContext
        enc = encoder(tokenizer)
        sink = writer = None
        fs, root = open_fs(folder)
        for batch in batches:
            for part in slices(batch, "_text"):
                if writer is None:
                    shard = part.column("_shard")[0].as_py()
                    name = f"ids-{shard:06d}.s8b"
                    tmp = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(tmp)
                    writer = Writer(sink)
                ids, lens = enc.encode(part.column("_text"))
                ids, lens = with_end(ids, lens, end_id)
                writer.add(part.column("_id").to_pylist(), ids, lens)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(tmp, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name],
                                              "n_docs": [len(writer.ids)],
                                              "n_ids": [writer.total]})

    out = placed.mapInArrow(run, "shard long, file string, n_docs long, n_ids long")
    return written(out, "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files in the manifest
    (only files that were committed are in it). One task reads one file at a time;
    ``start`` adds the ids of all earlier files, a sum over the manifest alone."""
    from pyspark.sql import Window
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = manifest.count()

    def run(batches):
        fs, root = open_fs(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(),
                                   batch.column("first").to_pylist()):
                rows = []
                with fs.open_input_file(f"{root}/{name}") as f:
                    for d, start, count, crc in read_file(f):
                        rows.append((d, first + start, count, crc))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows):
        d, s, c, k = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (d, s, c, k)],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (files.select("file", "first", "shard")
            .repartitionById(max(1, n), (F.col("shard") % max(1, n)).cast("int"))
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Write and read back: see ``write_token_files`` and ``read_token_files``."""
    folder = shared_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer, **kw), folder)
