"""Vector codes (product quantisation) by k-means with adaptive distance bounds.

Vectors become integers, are cut into parts, and every part is replaced by the number of
its nearest entry in that part's codebook. The codebooks are trained over all vectors.

Each part keeps, from round to round, its entry with an upper bound of the distance, its
``b`` next closest entries with ordered lower bounds, and one outer lower bound for all
other entries (Drake and Hamerly). When the entries have moved, the bounds move with them;
a part whose upper bound stays below its first lower bound keeps its entry unseen, one
that is below its z-th bound compares z entries, and only one that reaches the outer bound
compares all. ``b`` follows the number that parts needed in the round before. Whatever the
bounds leave open is decided by exact integer distances, ties to the lower entry, so the
codes are those of a search of all entries.

The state is a table in the shared folder that each round reads and writes anew (the one
before is deleted then); sums of the moved parts are added up per task before they are
grouped. Only codebooks (parts x entries x width integers) and sums of that size pass the
driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackrank.llm.common import dropped, same, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
FIRST_B, LEAST_B, COVER = 32, 2, 0.98
ROWS = 2048                               # rows handled at a time
ZERO = 1 << 31                            # integers as bytes that sort like the integers
SLACK = 1e-9                              # far above the rounding of distances in doubles


def limit(width: int) -> int:
    """Largest integer component: squared distances of parts stay below 2^62."""
    return 1 << ((62 - max(0, (width - 1).bit_length())) // 2 - 2)


def vectors(embeddings: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(vec_id, label, _q) with the integer components as bytes, and the width of a part.

    Null vectors and vectors with null or non-finite components are left out, and so are
    those whose length is not the most frequent one (the longer of two) or with a
    component beyond ``limit`` (a hundred thousand and more), whose errors no long can
    hold. Lengths that ``parts`` does not divide are filled up with zeros."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                             x.alias("_x")).where(x.isNotNull() & finite)
    first = (kept.groupBy(F.size("_x").alias("d")).count()
             .orderBy(F.desc("count"), F.desc("d")).limit(1).first())
    length = first["d"] if first else parts
    width = max(1, -(-length // parts))
    most = limit(width) / SCALE
    kept = kept.where((F.size("_x") == length) & F.forall("_x", lambda v: F.abs(v) < most))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(n, length)
            q = np.zeros((n, width * parts), np.int64)
            q[:, :length] = np.floor(SCALE * x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), _blobs((q + ZERO).astype(">u4"))],
                names=["vec_id", "label", "_q"])

    kind = embeddings.schema["label"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id long, label {kind}, _q binary"), width


def _blobs(a: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    a = np.ascontiguousarray(a)
    size = a.shape[1] * a.dtype.itemsize
    offs = np.arange(len(a) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offs), pa.py_buffer(a)])


def _matrix(col: pa.Array, dtype, *shape) -> np.ndarray:
    """The inverse of ``_blobs``: an array of (rows, *shape)."""
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, dtype).reshape(len(col), *shape)


def _ints(raw, *shape) -> np.ndarray:
    """Integer components from ``_q`` bytes."""
    return np.frombuffer(raw, ">u4").reshape(*shape).astype(np.int64) - ZERO


def _down(x):
    """float32 at or below."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


class Book:
    """One part's codebook of integer entries."""

    def __init__(self, entries: np.ndarray):
        self.c = entries.astype(np.int64)
        self.f = self.c.astype(np.float64)
        self.norm = (self.c * self.c).sum(axis=1)

    def all_distances(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances (rows x entries)."""
        top = max(int(np.abs(x).max(initial=0)), int(np.abs(self.c).max(initial=0)))
        if 4 * x.shape[1] * top * top < 1 << 53:      # doubles hold all sums exactly
            prod = (x.astype(np.float64) @ self.f.T).astype(np.int64)
        else:
            prod = x @ self.c.T
        return (x * x).sum(axis=1)[:, None] - 2 * prod + self.norm

    def distances(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Exact squared distances to the entries of each row (rows, or rows x some)."""
        d = (x[:, None, :] if entry.ndim == 2 else x) - self.c[entry]
        return (d * d).sum(axis=-1)


class Bounds:
    """State of one part of some rows: entry, upper bound, closest others and their bounds."""

    def __init__(self, entry, upper, near, low):
        self.entry, self.upper, self.near, self.low = entry, upper, near, low

    @classmethod
    def search(cls, book: Book, x: np.ndarray, b: int) -> "Bounds":
        d = book.all_distances(x)
        entry = d.argmin(axis=1)                      # the first of equal ones
        rows, k = np.arange(len(x)), len(book.c)
        upper = np.sqrt(d[rows, entry].astype(np.float64))
        d[rows, entry] = np.iinfo(np.int64).max
        b = min(b, k - 1)
        if b < k - 1:
            some = np.argpartition(d, b, axis=1)[:, :b + 1]
        else:
            some = np.argsort(d, axis=1)[:, :b]
        dist = np.sqrt(np.take_along_axis(d, some, 1).astype(np.float64))
        outer = dist[:, b:].min(axis=1, initial=np.inf)
        order = np.argsort(dist[:, :b], axis=1)
        near = np.take_along_axis(some[:, :b], order, 1)
        low = np.concatenate([np.take_along_axis(dist[:, :b], order, 1), outer[:, None]], axis=1)
        return cls(entry, upper, near, low)

    def narrowed(self, b: int) -> "Bounds":
        """With at most ``b`` closest entries; the others go behind the outer bound."""
        if b >= self.near.shape[1]:
            return self
        low = np.concatenate([self.low[:, :b], self.low[:, b:].min(axis=1)[:, None]], axis=1)
        return Bounds(self.entry, self.upper, self.near[:, :b], low)

    def follow(self, book: Book, x: np.ndarray, drift: np.ndarray, b: int):
        """State after the entries moved by at most ``drift``, and what each row needed: 0 no
        comparison, z the z closest, more than its bounds a search of all."""
        low = self.low - np.concatenate(
            [drift[self.near], np.full((len(x), 1), drift.max(initial=0))], axis=1)
        low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
        at = Bounds(self.entry.copy(), self.upper + drift[self.entry], self.near, low).narrowed(b)
        at.near, at.low = at.near.copy(), at.low.copy()
        need = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(at.low[:, 0] <= at.upper * (1 + SLACK) + SLACK)
        if not len(open_):
            return at, need
        at.upper[open_] = np.sqrt(book.distances(x[open_], at.entry[open_]).astype(np.float64))
        reach = at.upper[open_] * (1 + SLACK) + SLACK
        need[open_] = (at.low[open_] <= reach[:, None]).sum(axis=1)
        width = at.near.shape[1]
        for z in np.unique(need[open_]).tolist():
            rows = np.flatnonzero(need == z)
            if z > width:
                new = Bounds.search(book, x[rows], width)
                at.entry[rows], at.upper[rows] = new.entry, new.upper
                at.near[rows], at.low[rows] = new.near, new.low
            elif z:
                cand = np.sort(np.concatenate([at.entry[rows, None], at.near[rows, :z]], axis=1),
                               axis=1)
                d = book.distances(x[rows], cand)
                order = np.argsort(d, axis=1, kind="stable")       # ties to the lower entry
                cand = np.take_along_axis(cand, order, 1)
                dist = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
                at.entry[rows], at.upper[rows] = cand[:, 0], dist[:, 0]
                at.near[rows, :z], at.low[rows, :z] = cand[:, 1:], dist[:, 1:]
        return at, need


def _pack(states: list, prev: np.ndarray, needs: np.ndarray) -> list:
    """Arrow columns of the states of all parts (rows x parts x ...)."""
    up = np.stack([s.upper for s in states], 1)
    return [_blobs(np.stack([s.entry for s in states], 1).astype("<u2")),
            _blobs(prev.astype("<u2")), _blobs(needs.astype("<u2")), _blobs(up.astype("<f8")),
            _blobs(np.concatenate([s.near for s in states], 1).astype("<u2")),
            _blobs(np.concatenate([_down(s.low * (1 - SLACK)) for s in states], 1)
                   .astype("<f4"))]


STATE = ["_code", "_prev", "_need", "_up", "_near", "_low"]


def _steps(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


class Coder:
    """Codebooks of all parts (parts x entries x width) and the moves that led to them."""

    def __init__(self, books: np.ndarray, b: int, before: np.ndarray | None = None):
        self.books, self.b = books, b
        moved = np.zeros_like(books) if before is None else books - before
        # rounded up: an upper bound of every entry's move
        self.drift = np.sqrt((moved * moved).sum(axis=2).astype(np.float64)) * (1 + SLACK)

    def parts_of(self, batch):
        p, k, w = self.books.shape
        q = _ints(b"".join(batch.column("_q").to_pylist()), batch.num_rows, p, w)
        return [np.ascontiguousarray(q[:, i]) for i in range(p)]

    def first(self, batch):
        states = [Bounds.search(Book(c), x, self.b)
                  for c, x in zip(self.books, self.parts_of(batch))]
        n, p = batch.num_rows, len(self.books)
        return states, np.full((n, p), len(self.books[0])), np.zeros((n, p))

    def next(self, batch):
        p = len(self.books)
        prev = _matrix(batch.column("_code"), "<u2", p).astype(np.int64)
        upper = _matrix(batch.column("_up"), "<f8", p)
        near = _matrix(batch.column("_near"), "<u2", p, -1).astype(np.int64) \
            if len(self.books[0]) > 1 else np.zeros((batch.num_rows, p, 0), np.int64)
        low = _matrix(batch.column("_low"), "<f4", p, near.shape[2] + 1).astype(np.float64)
        got = [Bounds(prev[:, i], upper[:, i], near[:, i], low[:, i]).follow(
            Book(self.books[i]), x, self.drift[i], self.b)
            for i, x in enumerate(self.parts_of(batch))]
        return [s for s, _ in got], prev, np.stack([z for _, z in got], 1)


def _assign(rows: DataFrame, coder: Coder, started: bool) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(coder)     # of the size of the codebooks
    keep = ["vec_id", "label", "_q"]

    def run(batches):
        c = sent.value
        for batch in _steps(batches):
            cols = _pack(*(c.next(batch) if started else c.first(batch)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *cols],
                                             names=[*keep, *STATE])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, _q binary, "
                           + ", ".join(f"{c} binary" for c in STATE))


def _sums(state: DataFrame, shape: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of the entries' sums and counts by the parts that moved, and how many parts
    needed how many comparisons. Added up in each task first."""
    p, k, w = shape
    cells = p * k * (w + 1)

    def run(batches):
        total = np.zeros((p, k + 1, w + 1), np.int64)
        needs = np.zeros(k + 2, np.int64)
        for batch in _steps(batches):
            q = _ints(b"".join(batch.column("_q").to_pylist()), batch.num_rows, p, w)
            new = _matrix(batch.column("_code"), "<u2", p).astype(np.int64)
            old = _matrix(batch.column("_prev"), "<u2", p).astype(np.int64)
            needs += np.bincount(_matrix(batch.column("_need"), "<u2", p).ravel(),
                                 minlength=k + 2)
            for i in range(p):
                rows = np.flatnonzero(new[:, i] != old[:, i])
                x = np.concatenate([q[rows, i], np.ones((len(rows), 1), np.int64)], axis=1)
                for code, sign in ((new[rows, i], 1), (old[rows, i], -1)):
                    for j in range(w + 1):
                        total[i, :, j] += sign * np.bincount(
                            code, x[:, j], minlength=k + 1).astype(np.int64)
        flat = np.concatenate([total[:, :k].ravel(), needs])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "s"])

    got = (state.select("_q", "_code", "_prev", "_need").mapInArrow(run, "at long, s long")
           .groupBy("at").agg(F.sum("s").alias("s")).toPandas())      # cells + k + 2 at most
    flat = np.zeros(cells + k + 2, np.int64)
    flat[got["at"].to_numpy(np.int64)] = got["s"].to_numpy(np.int64)
    table = flat[:cells].reshape(p, k, w + 1)
    return table[..., :w], table[..., w], flat[cells:]


def adapted(b: int, needs: np.ndarray) -> int:
    """Closest entries to keep: as many as ``COVER`` of the parts that compared any needed."""
    some = needs[1:b + 1]
    if not some.sum():
        return min(b, LEAST_B)
    cover = np.searchsorted(np.cumsum(some), COVER * some.sum()) + 1
    return max(min(LEAST_B, b), min(b, int(cover)))


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, first_b: int = FIRST_B):
    """(codes, codebooks, steps): the rows (vec_id, label, codes array<int>, error long), the
    entries as an array (parts, entries, width), and per round ``b`` and how many parts
    needed how many comparisons.

    The first entries are the parts of the smallest vec_ids (null ids last, equal ids by
    their components). Repeated rows count as often as they occur; an empty table gives no row; other columns are dropped. Rows left out: see
    ``vectors``.
    """
    rows, width = vectors(embeddings, parts)
    rows = written(rows, "vectors")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "_q").limit(entries).collect()
    if not start:
        none = rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"),
                           F.lit(0).cast("long").alias("error"))
        return none, np.zeros((parts, 0, width), np.int64), []
    books = np.stack([_ints(r["_q"], parts, width) for r in start], 1)
    coder = Coder(books, min(first_b, len(start) - 1))
    sums = np.zeros(books.shape, np.int64)
    counts = np.zeros(books.shape[:2], np.int64)
    state, steps = rows, []
    for n in range(rounds):
        before, state = state, written(_assign(state, coder, n > 0), f"codes-{n}")
        dropped(before)
        more, count, needs = _sums(state, books.shape)
        sums, counts = sums + more, counts + count
        steps.append({"b": coder.b, "needs": needs})
        b = adapted(coder.b, needs) if n else coder.b
        used = counts > 0
        new = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], coder.books)
        coder = Coder(new, b, coder.books)
    final = _final(state, coder, rounds > 0)
    done = written(final, "codes")
    dropped(state)
    return done, coder.books, steps


def _final(state: DataFrame, coder: Coder, started: bool) -> DataFrame:
    """The last assignment: codes and exact errors, no bounds."""
    sent = state.sparkSession.sparkContext.broadcast(coder)

    def run(batches):
        c = sent.value
        for batch in _steps(batches):
            states = (c.next(batch) if started else c.first(batch))[0]
            error = sum(Book(b).distances(x, s.entry) for b, x, s in
                        zip(c.books, c.parts_of(batch), states))
            code = np.stack([s.entry for s in states], 1).astype(np.int32)
            offs = np.arange(len(code) + 1, dtype=np.int32) * len(states)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array(code.ravel())),
                 pa.array(error, pa.int64())], names=["vec_id", "label", "codes", "error"])

    kind = state.schema["label"].dataType.simpleString()
    return state.mapInArrow(run, f"vec_id long, label {kind}, codes array<int>, error long")


def books_digest(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (of all vectors with an equal
    label) and codebooks_sha256."""
    codes, books, _ = compress(embeddings)
    per = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    got = codes.join(per, same(codes, per, ["label"]))
    return got.select("vec_id", F.array_join(F.transform(
        "codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry in DuckDB."""
    sql = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor({SCALE}::double * x)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
x AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x
  FROM v, range({parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM x WHERE r <= {entries})"""
    for n in range(rounds + 1):
        sql += f""",
a{n} AS MATERIALIZED (
  SELECT r, x.p, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (
    SELECT r, x.p, e, list_dot_product(x, x) - 2 * list_dot_product(x, c)
                      + list_dot_product(c, c) AS d
    FROM x JOIN c{n} USING (p)) x GROUP BY r, x.p)"""
        if n < rounds:
            sql += f""",
m{n} AS (
  SELECT p, e, list(floor(s / k) ORDER BY i) AS m FROM (
    SELECT p, e, i, sum(x[i]) AS s, count(*) AS k
    FROM a{n} JOIN x USING (r, p), range(1, 1 + (SELECT max(len(x)) FROM x)) t(i)
    GROUP BY p, e, i) GROUP BY p, e),
c{n + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM c{n} LEFT JOIN m{n} USING (p, e))"""
    return sql + f""",
h AS (SELECT sha256(array_to_string(flatten(list(list_transform(c, lambda y: y::bigint)
             ORDER BY p, e)), ',')) AS codebooks_sha256 FROM c{rounds}),
f AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code,
         sum(d)::bigint AS error
  FROM a{rounds} JOIN v USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
       codebooks_sha256
FROM f, h
"""


ORACLE = oracle()
