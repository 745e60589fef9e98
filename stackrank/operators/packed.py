"""Exact AUCs of linear scores that are computed inside the tasks.

With every feature of every (trial, target, fold) permuted, the scores are hundreds to a
customer. As rows they are shuffled and sorted twice; here each task computes, rounds and sorts
the scores of a chunk of its customers per group, and ships them packed: whole numbers of 1e-9,
differences of neighbours with their bytes in planes (three bytes a score once compressed), and
a count for each distinct score. A group is cut into ranges of the score of at most about
``rows_per_bucket`` rows; the task that merges a range counts its pairs of a positive and a
negative, and the offsets of the ranges, a small table, give the AUC as in ``positions``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackrank.operators.metrics import AUC_DIGITS, SCORE_DIGITS
from stackrank.operators.partials import BATCH_BYTES
from stackrank.operators.positions import SAMPLE, value_bounds

CHUNK = 32_768                  # customers whose scores are packed together
UNIT = 10.0 ** SCORE_DIGITS
KEYS = ("trial", "target_no", "fold", "pos", "bucket")
CLASSES = ("p", "n", "u")       # labels 1, 0 and null
PACKS = ", ".join([f"{k} int" for k in KEYS] + [f"{c} binary" for c in CLASSES])


def pack(values: np.ndarray, weights: np.ndarray | None = None) -> bytes:
    """Whole-numbered values and their counts, sorted and without repeats, as bytes."""
    if not len(values):
        return b""
    if weights is None:
        v, c = np.unique(values, return_counts=True)
    else:
        v, at = np.unique(values, return_inverse=True)
        c = np.zeros(len(v), np.int64)
        np.add.at(c, at, weights)
    small = bool(np.abs(v).max() < 2.0 ** 52)            # differences are exact
    d = np.diff(v, prepend=0.0).astype("<i8") if small else v.astype("<f8").view("<i8")
    kind = np.min_scalar_type(int(c.max()))
    return (bytes([small, kind.itemsize]) + d.view("u1").reshape(-1, 8).T.tobytes()
            + c.astype(kind).tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not blob:
        return np.empty(0), np.empty(0, np.int64)
    size = blob[1]
    n = (len(blob) - 2) // (8 + size)
    d = np.ascontiguousarray(np.frombuffer(blob, "u1", 8 * n, 2).reshape(8, n).T).view("<i8")[:, 0]
    v = np.cumsum(d).astype("f8") if blob[0] else d.view("<f8")
    return v, np.frombuffer(blob, f"<u{size}", n, 2 + 8 * n).astype(np.int64)


def merged(parts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts of several (values, counts)."""
    v = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts])
    if not len(v):
        return v, c
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return v[first], np.add.reduceat(c, first)


def twice_pairs(p, n) -> int:
    """Twice the negatives below each positive, plus those tied with it."""
    below = np.concatenate([[0], np.cumsum(n[1])])
    return int((p[1] * (below[np.searchsorted(n[0], p[0])]
                        + below[np.searchsorted(n[0], p[0], "right")])).sum())


class Linear:
    """Scores of the rows of ``audit.units``: one per (trial, target, fold) by its ``weights``, or
    with a ``shortlist`` one per feature of a target, the feature moved by ``d``."""

    def __init__(self, weights: dict, targets: int, shortlist: dict | None = None):
        self.weights, self.targets, self.shortlist = weights, targets, shortlist
        self.width = next(iter(weights.values())).shape[1] if weights else 0

    class arrays:
        """A batch's columns as arrays."""

        def __init__(self, b, targets: int, width: int):
            def wide(c, n):
                x = b.column(c)
                x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
                return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            self.trial, self.fold, self.l = (b.column(c).to_numpy() if isinstance(b, pa.Table) else
                                             b.column(c).to_numpy(zero_copy_only=False)
                                             for c in ("trial", "fold", "l"))
            self.n, self.zs = wide("n", 3 * targets), wide("zs", width)
            self.d = wide("d", width) if "d" in b.schema.names else None

        def groups(self):
            """((trial, fold), rows) of the batch."""
            for trial, fold in np.unique(np.stack([self.trial, self.fold]), axis=1).T:
                yield (int(trial), int(fold)), np.flatnonzero(
                    (self.trial == trial) & (self.fold == fold))

    def scores(self, x: arrays):
        """(trial, target, fold, pos or -1, class, scores, weights or None) of a batch. A customer
        counts once for each of its labels, a moved feature once for each of its label rows."""
        for (trial, fold), at in x.groups():
            w = self.weights[trial, fold]
            base, n = x.zs[at] @ w.T, x.n[at]
            rows = None if self.shortlist is None or (x.l[at] == 1).all() else x.l[at]
            for t in range(self.targets):
                for c in range(3):
                    k = n[:, c * self.targets + t]
                    m = np.flatnonzero(k)
                    if not len(m):
                        continue
                    s = base[m, t] * k[m]
                    if self.shortlist is None:
                        yield trial, t, fold, -1, c, s, None
                        continue
                    weight = None if rows is None else rows[m]
                    for j in self.shortlist.get(t, ()):
                        yield trial, t, fold, j, c, s + w[t, j] * x.d[at[m], j], weight

    def read(self, batches):
        """Batches joined to chunks of about ``CHUNK`` rows."""
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                yield self.arrays(pa.Table.from_batches(held), self.targets, self.width)
                held, rows = [], 0
        if rows:
            yield self.arrays(pa.Table.from_batches(held), self.targets, self.width)


def _bounds(rows: DataFrame, linear: Linear, rows_per_bucket: int) -> dict:
    """(trial, target, fold) -> split points of the scores, from the unmoved scores of a sample;
    they only place the ranges. Bounded by trials x targets x folds x quantiles."""
    plain = Linear(linear.weights, linear.targets)

    def run(batches):
        for x in plain.read(batches):
            for trial, t, fold, _, _, s, _ in plain.scores(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), v, np.int32)) for v in (trial, t, fold)]
                    + [pa.array(s)], names=["trial", "target_no", "fold", "score"])

    some = rows.where(F.pmod(F.xxhash64("customer_id"), F.lit(SAMPLE)) == 0)
    got = some.select("trial", "fold", "l", "n", "zs").mapInArrow(
        run, "trial int, target_no int, fold int, score double")
    q = value_bounds(got, ["trial", "target_no", "fold"], "score", None, rows_per_bucket).collect()
    return {(r["trial"], r["target_no"], r["fold"]): np.rint(np.array(r["_q"], "f8") * UNIT)
            for r in q if r["_q"]}


def packed_auc(rows: DataFrame, linear: Linear, targets, rows_per_bucket: int,
               sample_of: DataFrame | None = None) -> DataFrame:
    """(trial, target, fold, pos, auc) of ``linear.scores`` over ``rows``; the exact AUC of
    ``metrics`` on scores rounded alike."""
    bounds = _bounds(rows if sample_of is None else sample_of, linear, rows_per_bucket)
    cols = ["trial", "fold", "l", "n", "zs", *(["d"] if linear.shortlist is not None else [])]

    def packs(batches):
        for x in linear.read(batches):
            found: dict = {}
            for trial, t, fold, j, c, s, weight in linear.scores(x):
                v = np.rint(s * UNIT)
                cuts = bounds.get((trial, t, fold), ())
                b = np.searchsorted(cuts, v) if len(cuts) else None
                for k in range(len(cuts) + 1):
                    m = slice(None) if b is None else b == k
                    blob = pack(v[m], None if weight is None else weight[m])
                    if blob:
                        found.setdefault((trial, t, fold, j, k), [b"", b"", b""])[c] = blob
            yield from key_batches(KEYS, found)

    counts = range_aucs(rows.select(*cols).mapInArrow(packs, PACKS), KEYS, unpack)
    names = F.array(*[F.lit(t) for t in targets])
    return counts.select("trial", names[F.col("target_no")].alias("target"), "fold", "pos", "auc")


def range_aucs(packs: DataFrame, keys, unpack) -> DataFrame:
    """(keys without the last, n_pos, n_neg, auc) of packed scores (keys, CLASSES); the last key
    numbers the ranges of the score upwards."""
    def count(key, table):
        p, n, u = (merged([unpack(b) for b in table.column(c).to_pylist()]) for c in CLASSES)
        # a row without a label counts as a negative beside labelled rows of its score only
        beside = np.isin(u[0], p[0]) | np.isin(u[0], n[0])
        n = merged([n, (u[0][beside], u[1][beside])])
        return pa.table({**{k: pa.array([v.as_py()], pa.int32()) for k, v in zip(keys, key)},
                         "n_pos": pa.array([int(p[1].sum())], pa.int64()),
                         "n_neg": pa.array([int(n[1].sum())], pa.int64()),
                         "twice": pa.array([twice_pairs(p, n)], pa.int64())})

    counts = packs.groupBy(*keys).applyInArrow(
        count, ", ".join(f"{k} int" for k in keys) + ", n_pos long, n_neg long, twice long")
    *group, last = keys
    w = Window.partitionBy(*group).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    whole = "decimal(20,0)"
    below = F.coalesce(F.sum("n_neg").over(w), F.lit(0)).cast(whole)
    c = counts.withColumn("twice", F.col("twice").cast(whole)
                          + F.col("n_pos").cast("decimal(17,0)") * below * F.lit(2))
    c = c.groupBy(*group).agg(F.sum("twice").cast("double").alias("_t"),
                              F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double") * 2
    return c.select(*group, "n_pos", "n_neg",
                    F.round(F.try_divide("_t", pairs), AUC_DIGITS).alias("auc"))


def key_batches(keys, found: dict):
    """Record batches (keys, CLASSES) of a dictionary from keys to the blobs of the classes."""
    out, size = [], 0
    for key, blobs in found.items():
        out.append((*key, *blobs))
        size += sum(map(len, blobs))
        if size >= BATCH_BYTES:
            yield _batch(keys, out)
            out, size = [], 0
    if out:
        yield _batch(keys, out)


def _batch(keys, rows):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int32()) for c in cols[:len(keys)]]
        + [pa.array(c, pa.binary()) for c in cols[len(keys):]], names=[*keys, *CLASSES])
