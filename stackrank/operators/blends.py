"""AUCs of weighted sums of scores, computed inside the tasks.

A search over weights asks for the AUC of many points (weights) of every target. As rows that is
a score per row and point; here the rows of a target lie packed in blocks (a matrix of scores,
the rows in the order of their classes), and a task computes the sums of a block point by point,
term after term as a plain expression would, so they are the same doubles.

``bounds`` counts positives and negatives per bin of the score and so bounds every AUC from both
sides; ``aucs`` is exact: each task sorts and packs its sums per range of the score, and the task
that holds a range counts its pairs (as in ``packed``).
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackrank.operators.metrics import BOUND_SLACK
from stackrank.operators.packed import CLASSES, key_batches, range_aucs
from stackrank.operators.partials import partial_rows, summed
from stackrank.operators.positions import ROWS_PER_BUCKET, SAMPLE, value_bounds

BLOCK = 32_768                              # rows of a block
PER_FILE = 16                               # blocks of a file
CELLS = 4 << 20                             # counts that a task holds at once
NULL_SCORE = 4                              # flag of a row that has no score
CODES = (1, 0, 2)                           # labels 1, 0 and null, in the order of CLASSES
BLOCKS = "target_no int, n int, y binary, x binary"


def half_up(s: np.ndarray, digits: int) -> np.ndarray:
    """Spark's ``round``: half up on the shortest decimal of a double."""
    unit = 10.0 ** digits
    scaled = s * unit
    out = np.rint(scaled) / unit
    part = np.abs(scaled - np.floor(scaled) - 0.5)
    hard = np.isfinite(s) & ((part < 1e-5) | (np.abs(scaled) > 2.0 ** 34))
    step = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(hard).tolist():
        v = Decimal(repr(float(s[i])))
        out[i] = float(v.quantize(step, ROUND_HALF_UP)) if abs(v) < 10 ** 15 else s[i]
    return out


def ordered(s: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    k = np.ascontiguousarray(s, "<f8").view("<i8")
    return np.where(k < 0, np.int64(-2 ** 63) - k - 1, k)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers and their counts, sorted and without repeats, as bytes."""
    if not len(values):
        return b""
    v, c = np.unique(values, return_counts=True)
    kind = np.min_scalar_type(int(c.max()))
    d = np.diff(v.view("<u8"), prepend=np.uint64(0))     # wraps around, as does the sum
    return bytes([kind.itemsize]) + d.view("u1").reshape(-1, 8).T.tobytes() + c.astype(kind).tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not blob:
        return np.empty(0, "<i8"), np.empty(0, np.int64)
    size = blob[0]
    n = (len(blob) - 1) // (8 + size)
    d = np.ascontiguousarray(np.frombuffer(blob, "u1", 8 * n, 1).reshape(8, n).T).view("<u8")[:, 0]
    return np.cumsum(d).view("<i8"), np.frombuffer(blob, f"<u{size}", n, 1 + 8 * n).astype(np.int64)


class Blends:
    """Packed rows of a table (target, y, columns)."""

    def __init__(self, wide: DataFrame, targets, columns, lost=None, digits: int | None = None):
        """``lost``: condition of the rows whose sums are null whatever the weights; other
        nulls count as 0. ``digits`` rounds the sums."""
        from stackrank.sources.context import stored
        self.targets, self.digits = sorted(targets), digits
        self.spark = wide.sparkSession
        no = F.array_position(F.array(*[F.lit(t) for t in self.targets]), F.col("target")) - 1
        flag = F.lit(0) if lost is None else F.when(lost, NULL_SCORE).otherwise(0)
        cells = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}")
                 for i, c in enumerate(columns)]
        rows = wide.select(no.cast("int").alias("target_no"),
                           (F.coalesce(F.col("y"), F.lit(2)) + flag).cast("int").alias("y"), *cells)
        width = len(columns)

        def block(t, y, x):
            order = np.argsort(y % NULL_SCORE, kind="stable")
            return pa.RecordBatch.from_arrays(
                [pa.array([t], pa.int32()), pa.array([len(y)], pa.int32()),
                 pa.array([y[order].astype("u1").tobytes()], pa.binary()),
                 pa.array([np.ascontiguousarray(x[:, order], "<f8").tobytes()], pa.binary())],
                names=["target_no", "n", "y", "x"])

        def run(batches):
            held: dict = {}
            for b in batches:
                no, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("target_no", "y"))
                x = np.stack([b.column(f"x{i}").to_numpy(zero_copy_only=False)
                              for i in range(width)])
                for t in np.unique(no).tolist():
                    at = np.flatnonzero(no == t)
                    parts = held.setdefault(t, [])
                    parts.append((y[at], x[:, at]))
                    if sum(len(p[0]) for p in parts) >= BLOCK:
                        ys = np.concatenate([p[0] for p in parts])
                        xs = np.concatenate([p[1] for p in parts], axis=1)
                        whole = len(ys) // BLOCK * BLOCK
                        for k in range(0, whole, BLOCK):
                            yield block(t, ys[k:k + BLOCK], xs[:, k:k + BLOCK])
                        held[t] = [(ys[whole:], xs[:, whole:])]
            for t, parts in held.items():
                ys = np.concatenate([p[0] for p in parts])
                if len(ys):
                    yield block(t, ys, np.concatenate([p[1] for p in parts], axis=1))

        self.blocks = stored(rows.mapInArrow(run, BLOCKS), PER_FILE)
        self.span = self._span()

    def _span(self) -> dict:
        """target -> the least and the largest score (0 counts as one)."""
        def run(batches):
            for t, _, x in self.read(batches):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([min(0.0, float(np.nanmin(x)))]),
                     pa.array([max(0.0, float(np.nanmax(x)))])], names=["target_no", "a", "b"])
        got = self.blocks.mapInArrow(run, "target_no int, a double, b double").groupBy(
            "target_no").agg(F.min("a").alias("a"), F.max("b").alias("b")).collect()
        return {r["target_no"]: (r["a"], r["b"]) for r in got}

    def __getstate__(self):                 # what the tasks need
        return {"digits": self.digits, "span": getattr(self, "span", None)}

    @staticmethod
    def read(batches):
        """(target_no, y, x) of every block."""
        for b in batches:
            for t, n, y, x in zip(*[b.column(c).to_pylist() for c in ("target_no", "n", "y", "x")]):
                yield t, np.frombuffer(y, "u1"), np.frombuffer(x, "<f8").reshape(-1, n)

    def sums(self, x, lost, w) -> np.ndarray:
        """The weighted sums of a block: terms added one after the other; null is below all."""
        s = w[0] * x[0]
        for j in range(1, len(w)):
            s += w[j] * x[j]
        if self.digits is not None:
            s = half_up(s, self.digits)
        s += 0.0                                            # one zero
        s[np.isnan(s)] = np.inf
        s[lost] = -np.inf
        return s

    @staticmethod
    def classes(y) -> list:
        """Slices of a block's labels 1, 0 and null."""
        code = y % NULL_SCORE
        return [slice(*np.searchsorted(code, [c, c + 1])) for c in CODES]

    def _numbered(self, points: dict) -> dict:
        """target -> [(point, weights)] as target number -> the same."""
        return {self.targets.index(t): [(int(i), np.asarray(w, float)) for i, w in v]
                for t, v in points.items() if v}

    def bounds(self, points: dict, bins: int) -> dict:
        """(target, point) -> (lower or None, upper bound of the AUC) by counts per bin. Pairs of
        one bin count 0 or 1; a row without a label counts as a negative beside labelled rows of
        its score only: the lower bound is without such rows, the upper one with them."""
        flat = [(t, i, w) for t, v in self._numbered(points).items() for i, w in v]
        some, out = max(1, CELLS // (3 * (bins + 1))), {}
        for k in range(0, len(flat), some):
            out.update(self._bounds(flat[k:k + some], bins))
        return out

    def _bounds(self, flat: list, bins: int) -> dict:
        own: dict = {}
        for t, i, w in flat:
            own.setdefault(t, []).append((i, w))
        sent = self.spark.sparkContext.broadcast(own)

        def run(batches):
            total: dict = {}
            for t, y, x in self.read(batches):
                lost, parts = y >= NULL_SCORE, self.classes(y)
                low, high = self.span[t]
                scale = bins / (high - low) if high > low else 0.0
                for i, w in sent.value.get(t, ()):
                    with np.errstate(invalid="ignore"):
                        at = np.clip(np.floor((self.sums(x, lost, w) - low) * scale), -1, bins - 1)
                    at = np.where(lost, 0, np.nan_to_num(np.maximum(at, 0)) + 1).astype(np.int64)
                    c = total.setdefault((t, i), np.zeros((3, bins + 1)))
                    for k, part in enumerate(parts):
                        c[k] += np.bincount(at[part], minlength=bins + 1)
            yield from partial_rows(("target_no", "point"), {k: v.ravel() for k, v in total.items()})

        def finish(key, total):
            p, n, u = total.reshape(3, -1)
            m = n + u
            under, least = np.cumsum(n) - n, p.sum() * n.sum()
            most = p.sum() * m.sum()
            return {"low": float(p @ under) / most if most else None,
                    "high": float(p @ np.cumsum(m)) / least if least else float("inf")}

        got = summed(self.blocks.mapInArrow(run, "target_no int, point int, blob binary"),
                     ("target_no", "point"), finish, "low double, high double").collect()
        sent.destroy()
        return {(self.targets[r["target_no"]], r["point"]): (r["low"], r["high"]) for r in got}

    def contenders(self, points: dict, bins: int, penalty, floor: dict | None = None) -> dict:
        """The points that can have the best AUC less ``penalty(target, point)`` of their target,
        and more than ``floor[target]`` where that is given. Targets of one class keep their
        first point."""
        known, out = self.bounds(points, bins), {}
        for t, v in points.items():
            own = [(i, w, *known[t, i]) for i, w in v if (t, int(i)) in known]
            low = [a - penalty(t, i) for i, _, a, _ in own if a is not None]
            if not own:
                continue
            if not low:
                out[t] = [min(((i, w) for i, w, _, _ in own), key=lambda p: p[0])]
                continue
            best = max([*low, *([floor[t]] if floor else [])])
            kept = [(i, w) for i, w, _, b in own if b - penalty(t, i) >= best - BOUND_SLACK]
            if kept:
                out[t] = kept
        return out

    def aucs(self, points: dict, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
        """(target, point, n_pos, n_neg, auc), exact."""
        sent = self.spark.sparkContext.broadcast(self._numbered(points))

        def sample(batches):
            for t, y, x in self.read(batches):
                some = slice(SAMPLE // 2, None, SAMPLE)
                for i, w in sent.value.get(t, ()):
                    s = self.sums(x[:, some], y[some] >= NULL_SCORE, w)
                    s = s[np.isfinite(s)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), v, np.int32)) for v in (t, i)] + [pa.array(s)],
                        names=["target_no", "point", "score"])

        got = self.blocks.mapInArrow(sample, "target_no int, point int, score double")
        cuts = {(r["target_no"], r["point"]): ordered(np.array(r["_q"], "f8")) for r in value_bounds(
            got, ["target_no", "point"], "score", None, rows_per_bucket).collect() if r["_q"]}

        def packs(batches):
            for t, y, x in self.read(batches):
                lost, parts, found = y >= NULL_SCORE, self.classes(y), {}
                for i, w in sent.value.get(t, ()):
                    v = ordered(self.sums(x, lost, w))
                    at = np.searchsorted(cuts[t, i], v) if (t, i) in cuts else np.zeros(len(v), int)
                    for k in np.unique(at).tolist():
                        found[t, i, k] = [pack(v[part][at[part] == k]) for part in parts]
                yield from key_batches(keys, found)

        keys = ("target_no", "point", "bucket")
        rows = self.blocks.mapInArrow(packs, ", ".join(
            [f"{k} int" for k in keys] + [f"{c} binary" for c in CLASSES]))
        names = F.array(*[F.lit(t) for t in self.targets])
        return range_aucs(rows, keys, unpack).select(
            names[F.col("target_no")].alias("target"), "point", "n_pos", "n_neg", "auc")
