"""Packing documents into training sequences: first-fit decreasing in random groups.

Documents are dealt to tasks in random order; each task cuts them into groups of a
bounded number of ids and packs each group on its own, so memory does not depend
on the partition and no group waits for another. Within a group the pieces go by
decreasing length into the first sequence with room, found in log2(bins) steps
in a tournament tree whose nodes hold the largest room below them.

Documents longer than a sequence are cut into whole sequences and a rest. What a
group leaves half full (the last few sequences) is cut once more into power-of-two
lengths, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackrank.llm.common import slices
from stackrank.llm.tokens import encoder, with_end

GROUP_IDS = 8 << 20


class TournamentTree:
    """Room of ``n`` bins; ``first_fit(size)`` is the lowest bin with that much room."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < need:
                i += 1
        return i - self.size

    def take(self, bin_: int, amount: int) -> int:
        """Use up room of a bin; returns the room it had."""
        room, i = self.room, bin_ + self.size
        had = room[i]
        room[i] = had - amount
        i //= 2
        while i:
            a, b = room[2 * i], room[2 * i + 1]
            m = a if a >= b else b
            if room[i] == m:
                break
            room[i] = m
            i //= 2
        return had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece; every length is 1 to ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return bins, offset
    # first fit never opens more bins than twice the ids need, plus one
    tree = TournamentTree(min(len(lengths), 2 * int(lengths.sum()) // capacity + 2), capacity)
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        b = tree.first_fit(need)
        bins[i] = b
        offset[i] = capacity - tree.take(b, need)
    return bins, offset


def pack_lengths(lengths: np.ndarray, capacity: int, slack: int) -> list:
    """Pieces (item, start, length, sequence, offset) for items of the given lengths.

    Whole sequences are cut from long items; the rests are packed first-fit
    decreasing. A sequence with more than ``slack`` free places is cut into
    sequences of power-of-two lengths.
    """
    whole = lengths // capacity
    pieces, seq = [], 0
    for i in np.flatnonzero(whole).tolist():
        for k in range(int(whole[i])):
            pieces.append((i, k * capacity, capacity, seq, 0))
            seq += 1
    rest = lengths - whole * capacity
    items = np.flatnonzero(rest)
    bins, offset = first_fit_decreasing(rest[items], capacity)
    begin = (whole * capacity)[items]
    fill = np.bincount(bins, weights=rest[items]).astype(np.int64) if len(items) else bins
    order = np.lexsort((offset, bins))
    bound = {}
    for b, f in enumerate(fill.tolist()):
        if 0 < capacity - f <= slack or f == capacity:
            bound[b] = [(0, f, seq)]
            seq += 1
        else:
            bound[b], at = [], 0
            while at < f:
                size = 1 << ((f - at).bit_length() - 1)
                bound[b].append((at, at + size, seq))
                at, seq = at + size, seq + 1
    for j in order.tolist():
        item, lo = int(items[j]), int(offset[j])
        hi = lo + int(rest[item])
        for a, e, s in bound[int(bins[j])]:
            x, y = max(a, lo), min(e, hi)
            if x < y:
                pieces.append((item, int(begin[j]) + x - lo, y - x, s, x - a))
    return pieces


OUT = ("doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
       "sequence_id long, offset long, sequence_length long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096,
                   slack: int = 64, group_ids: int = GROUP_IDS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), ids_crc32,
    doc_tokens, sequence_id (unique, not gapless), offset in it, sequence_length.

    Null and empty texts are a piece with the end id alone; repeated rows and null
    ids are packed like any other row; other columns are ignored; an empty table
    gives no row. One shuffle of the texts deals the rows out at random, evenly
    whatever the keys are; groups end after ``group_ids`` ids.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).alias("_text")).repartition(n)

    def flush(ids, lens, doc_ids, first_seq):
        ids, lens = np.concatenate(ids), np.concatenate(lens)
        pieces = pack_lengths(lens, capacity, slack)
        base = np.cumsum(lens) - lens
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        fill = {}
        for _, _, length, s, _ in pieces:
            fill[s] = fill.get(s, 0) + length
        for a in range(0, len(pieces), 4096):
            rows = []
            for i, start, length, s, off in pieces[a:a + 4096]:
                b = 4 * (int(base[i]) + start)
                cut = raw[b:b + 4 * length]
                rows.append((doc_ids[i], start, length, bytes(cut), zlib.crc32(cut),
                             int(lens[i]), first_seq + s, off, fill[s]))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                names=[x.split()[0] for x in OUT.split(", ")])

    def run(batches):
        from pyspark import TaskContext
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        ids, lens, doc_ids, size, group = [], [], [], 0, 0
        for batch in batches:
            for piece in slices(batch, "_text"):
                x, c = with_end(*enc.encode(piece.column("_text")), end_id)
                ids.append(x)
                lens.append(c)
                doc_ids += piece.column("doc_id").to_pylist()
                size += len(x)
                if size >= group_ids:
                    yield from flush(ids, lens, doc_ids, (part << 40) + (group << 24))
                    ids, lens, doc_ids, size, group = [], [], [], 0, group + 1
        if doc_ids:
            yield from flush(ids, lens, doc_ids, (part << 40) + (group << 24))

    return dealt.mapInArrow(run, OUT)
