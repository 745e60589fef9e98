"""Rank transforms and top-k selections.

Rank-normalise (I1) maps the scores of a group onto [0, 1] by position; ties are
broken by a hash of the id and then the id (the reference breaks them by file
order, which is not reproducible). Average rank (I2) gives tied scores the mean
of their positions. Neither puts a group into one task: rows fall into value ranges of
their group, and the rows of a split point (a score that ties many rows is one) are cut
again by a hash. A range has one number, by which the rows are shuffled once and laid side
by side; the order inside a range is found over its arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stackrank.functions.hashing import h
from stackrank.operators.positions import value_bounds, with_bucket

TIE_SALT = "tie"
HASHES = float(1 << 32)
RANGE_ROWS = 1 << 17        # rows of a range, which a task orders as a whole


def _same(a: str, b: str, cols) -> Column:
    """Equal ``cols`` of two aliased tables; null equals null."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


class _Ranges:
    """Value ranges of the groups of ``df``: ``rows`` has their number ``_k`` in place of the
    group columns, ``table`` (groups x ranges) the group columns, ``_s`` (0: a range; else a
    part of the rows of its upper split point), ``_n`` rows of the group, ``_off`` rows before
    the range, and ``_tied`` rows of the split point with ``_under`` rows below it."""

    def __init__(self, df: DataFrame, group_cols: list, score_col: str, by: str, hash32: Column,
                 rows_per_bucket: int | None):
        from stackrank.sources.context import cut
        self.group_cols = group_cols
        bounds = cut(value_bounds(df, group_cols, score_col, by,
                                  rows_per_bucket or RANGE_ROWS))

        def placed(groups):
            both = df.alias("a").join(F.broadcast(groups).alias("b"),
                                      _same("a", "b", group_cols), "left")
            d = with_bucket(both.select("a.*", *[c for c in groups.columns
                                                 if c not in group_cols]), score_col)
            tied = F.coalesce(F.get("_q", F.col("_b")) == F.col(score_col), F.lit(False))
            part = F.floor(hash32 * F.get("_parts", F.col("_b")) / F.lit(HASHES)).cast("int") + 1
            # within a range the split point itself comes last, its rows by hash
            return d.withColumn("_s", F.when(tied, part).otherwise(F.lit(0)))

        counts = placed(bounds).groupBy(*group_cols, "_b", "_s").agg(
            F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*group_cols)
        before = w.orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
        point = Window.partitionBy(*group_cols, "_b", F.col("_s") > 0)
        counts = cut(counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
                     .withColumn("_n", F.sum("_c").over(w))
                     .withColumn("_tied", F.sum("_c").over(point))
                     .withColumn("_under", F.min("_off").over(point)))
        # one row a group: numbers for the groups
        groups = cut(counts.select(*group_cols).distinct().withColumn(
            "_g", F.row_number().over(Window.orderBy(*group_cols)).cast("bigint")))
        key = F.shiftleft("_g", 24) + F.shiftleft(F.col("_b"), 12) + F.col("_s")
        known = groups.alias("a").join(bounds.alias("b"), _same("a", "b", group_cols), "left")
        known = known.select(*[F.col(f"a.{c}").alias(c) for c in group_cols], "_g", "_q", "_parts")
        kept = [c for c in df.columns if c not in group_cols]
        self.rows = placed(known).select(key.alias("_k"), *kept)
        numbered = counts.alias("a").join(groups.alias("b"), _same("a", "b", group_cols))
        self.table = numbered.select(
            *[F.col(f"a.{c}").alias(c) for c in group_cols], key.alias("_k"), "_s", "_off", "_n",
            "_tied", "_under")

    def each(self, run, out: str, drop=()) -> DataFrame:
        """The rows with ``out`` = ``run(range's table)``, the columns of ``table`` attached."""
        kept = [f for f in self.rows.schema if f.name not in drop]
        names = [f.name for f in kept]

        def add(table: pa.Table) -> pa.Table:
            got = pa.array(run(table), pa.int64())
            return table.select(names).append_column(out, got)

        made = self.rows.groupBy("_k").applyInArrow(
            add, StructType([*kept, StructField(out, LongType())]))
        return made.join(F.broadcast(self.table), "_k")


def _sortable(col) -> tuple[np.ndarray, np.ndarray | None]:
    """(numbers, class or None) that order a column as Spark does: nulls, numbers, NaN."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not pa.types.is_floating(col.type):
        return pc.rank(col, null_placement="at_start", tiebreaker="dense").to_numpy(), None
    null = col.is_null().to_numpy(zero_copy_only=False)
    v = col.fill_null(0.0).to_numpy(zero_copy_only=False)
    nan = np.isnan(v)
    if not null.any() and not nan.any():
        return v, None
    return np.where(nan, 0.0, v), np.where(null, 0, np.where(nan, 2, 1))


def order_of(score, hashes, ids) -> np.ndarray:
    """Row numbers in the order of (score, hash, id)."""
    v, kind = _sortable(score)
    x = hashes.to_numpy()
    order = np.lexsort((x, v) if kind is None else (x, v, kind))
    v, x = v[order], x[order]
    same = (v[1:] == v[:-1]) & (x[1:] == x[:-1])
    if kind is not None:
        kind = kind[order]
        same &= kind[1:] == kind[:-1]
    if same.any():                              # equal hashes: by id, these rows only
        run = np.cumsum(np.concatenate([[True], ~same]))
        at = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        rank = _sortable(ids.take(pa.array(order[at])))[0]
        order[at] = order[at][np.lexsort((rank, run[at]))]
    return order


def twice_rank(score) -> np.ndarray:
    """Twice the average 1-based rank of each row."""
    v, kind = _sortable(score)
    if kind is not None:
        v = np.unique(np.stack([kind, v]), axis=1, return_inverse=True)[1].ravel()
    ordered = np.sort(v)
    low, high = np.searchsorted(ordered, v, "left"), np.searchsorted(ordered, v, "right")
    return (low + high + 1).astype(np.int64)


def rank_normalize(df: DataFrame, group_cols, score_col: str = "score",
                   id_col: str = "customer_id", out: str = "rank_score",
                   rows_per_bucket: int | None = None, hash_col: str | None = None) -> DataFrame:
    """Add ``out`` = position / (n - 1) under the order (score, h(id), id); 0 if n = 1.

    ``hash_col`` may name a column that holds h(id) already (it is dropped)."""
    group_cols = list(group_cols)
    d = df.withColumn("_h", h(TIE_SALT, id_col) if hash_col is None else F.col(hash_col))
    if hash_col not in (None, "_h"):
        d = d.drop(hash_col)
    ranges = _Ranges(d, group_cols, score_col, id_col, F.col("_h"), rows_per_bucket)

    def positions(table):
        order = order_of(table.column(score_col), table.column("_h"), table.column(id_col))
        pos = np.empty(len(order), np.int64)
        pos[order] = np.arange(len(order))
        return pos

    pos = F.col("_off") + F.col("_pos")
    got = ranges.each(positions, "_pos", drop=("_h",)).withColumn(
        out, F.when(F.col("_n") > 1, pos / (F.col("_n") - 1)).otherwise(F.lit(0.0)))
    return got.select(*[c for c in df.columns if c not in (hash_col, out)], out)


def rank_average(df: DataFrame, group_cols, score_col: str = "score", out: str = "rank_avg",
                 rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``out`` = average 1-based rank of the score / n (ties share the mean). Rows without
    a score count as the lowest and are left out."""
    group_cols = list(group_cols)
    others = [c for c in df.columns if c not in (*group_cols, score_col)]
    by = "_row"
    d = df.withColumn(by, F.xxhash64(*(others or [score_col])))
    spread = F.col(by).bitwiseAND(F.lit((1 << 32) - 1))
    ranges = _Ranges(d, group_cols, score_col, by, spread, rows_per_bucket)
    twice = F.when(F.col("_s") > 0, F.col("_under") * 2 + F.col("_tied") + 1).otherwise(
        F.col("_off") * 2 + F.col("_twice"))
    return (ranges.each(lambda t: twice_rank(t.column(score_col)), "_twice", drop=(by,))
            .where(F.col(score_col).isNotNull())
            .withColumn(out, (twice / 2.0) / F.col("_n"))
            .select(*[c for c in df.columns if c != out], out))
