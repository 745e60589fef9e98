"""Exact positions and running sums inside groups, without one task per group.

A plain ``row_number() OVER (PARTITION BY g ORDER BY ...)`` sends a whole group to one
task; a target, a stratum or a score source can hold a third of all rows. Both helpers
here give the same numbers as the single window by one plan at every size:

1. each row gets a sub-bucket that is monotone in the sort order: a hash prefix, or
   the interval of the value between quantiles of its group. The number of buckets
   follows from the group's rows (``rows_per_bucket`` rows each);
2. counts / sums per (group, bucket), a table bounded by groups x buckets, give the
   offset of each bucket;
3. rows are numbered (or summed) inside (group, bucket) only and the offset is added.

Groups are configuration (targets, folds, sources, features, grid points), so the
tables of steps 1 and 2 are broadcast; the rows are shuffled once. Buckets depend on
values, not on partitioning, so recomputed tasks after an executor loss agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackrank.functions.hashing import h

HASH_BITS, FINE_BITS = 32, 12
ROWS_PER_BUCKET = 1_000_000
QUANTILES = 512           # at most so many value buckets of a group
SAMPLE = 64               # quantiles are taken from about one row in SAMPLE


def _attach(df: DataFrame, small: DataFrame, cols: list) -> DataFrame:
    """Join a table with one row per ``cols`` (bounded) to ``df``."""
    small = F.broadcast(small)
    return df.join(small, cols, "left") if cols else df.crossJoin(small)


def hash_positions(df: DataFrame, group_cols, salt: str, id_col: str = "customer_id",
                   out: str = "pos", hash_col: str = "_h", hash_extra=(),
                   rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position inside ``group_cols`` ordered by
    (h(salt, *hash_extra, id), id).

    Also keeps the hash in ``hash_col`` (callers reuse it as a sort key).
    """
    group_cols = list(group_cols)
    rows = rows_per_bucket or ROWS_PER_BUCKET
    d = df.withColumn(hash_col, h(salt, *hash_extra, id_col)).withColumn(
        "_f", F.shiftright(F.col(hash_col), HASH_BITS - FINE_BITS))
    fine = d.groupBy(*group_cols, "_f").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols)
    # 2^bits buckets hold at most about ``rows`` rows each
    bits = F.least(F.lit(FINE_BITS), F.greatest(F.lit(0), F.ceil(
        F.log2(F.sum("_n").over(w) / F.lit(rows))))).cast("int")
    fine = fine.withColumn("_b", F.floor(
        F.col("_f") / F.pow(F.lit(2.0), F.lit(FINE_BITS) - bits)).cast("bigint"))
    before = w.orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group_cols, "_b").orderBy(hash_col, id_col)
    return (_attach(d, fine, [*group_cols, "_f"])
            .withColumn(out, (F.col("_off") + F.row_number().over(inside) - 1).cast("bigint"))
            .drop("_f", "_b", "_off"))


def value_bounds(df: DataFrame, group_cols: list, value: str, by: str | None,
                 rows_per_bucket: int | None = None) -> DataFrame:
    """(group..., _q, _parts): ascending split points of ``value`` in each group, about one per
    ``rows_per_bucket`` rows, and how many of them fell on each (a value that ties many rows),
    from the rows whose hash of ``by`` falls on one in SAMPLE (``by`` None: ``df`` holds only
    those). The sample only places the splits; results do not depend on it."""
    rows = rows_per_bucket or ROWS_PER_BUCKET
    some = df if by is None else df.where(F.pmod(F.xxhash64(by), F.lit(SAMPLE)) == 0)
    q = some.groupBy(*group_cols).agg(
        F.percentile_approx(value, [i / QUANTILES for i in range(1, QUANTILES)], 2_000).alias("_a"),
        (F.count(F.lit(1)) * SAMPLE).alias("_n"))
    step = F.greatest(F.lit(1), F.least(F.lit(QUANTILES), F.floor(
        F.lit(float(rows)) * QUANTILES / F.col("_n")))).cast("int")
    taken = q.withColumn("_k", step).withColumn("_a", F.filter(
        "_a", lambda x, i: (i + 1) % F.col("_k") == 0)).withColumn("_q", F.array_distinct("_a"))
    return taken.select(*group_cols, "_q", F.transform("_q", lambda v: F.size(F.filter(
        "_a", lambda x: x == v))).alias("_parts"))


def with_bucket(df: DataFrame, value: str, bounds: str = "_q") -> DataFrame:
    """Add ``_b``: number of bounds strictly below the value (binary search): monotone, and
    equal values share a bucket. A projection a step, so that the search is compiled: a
    lambda over an array is interpreted row by row."""
    lo, k = F.lit(0), 1
    while 2 * k < QUANTILES:
        k *= 2
    out, step = df, 0
    while k:
        below = F.get(F.col(bounds), lo + F.lit(k - 1)) < F.col(value)   # null beyond the end
        out = out.withColumn(f"_lo{step % 2}", lo + F.when(below, F.lit(k)).otherwise(F.lit(0)))
        lo, step, k = F.col(f"_lo{step % 2}"), step + 1, k // 2
    return out.withColumn("_b", lo).drop("_lo0", "_lo1")


def exclusive_running_sums(df: DataFrame, group_cols, order_col: str, sum_cols,
                           suffix: str = "_below",
                           rows_per_bucket: int | None = None) -> DataFrame:
    """For rows unique per (group, order_col): add ``<c>_below`` = sum of ``c`` over
    rows of the same group with a strictly smaller ``order_col``."""
    group_cols, sum_cols = list(group_cols), list(sum_cols)
    bounds = value_bounds(df, group_cols, order_col, order_col, rows_per_bucket)
    d = with_bucket(_attach(df, bounds, group_cols), order_col).drop("_q", "_parts")
    tot = d.groupBy(*group_cols, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    w_off = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = tot.select(*group_cols, "_b", *[
        F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    w_in = Window.partitionBy(*group_cols, "_b").orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, -1)
    out = _attach(d, offsets, [*group_cols, "_b"])
    for c in sum_cols:
        out = out.withColumn(
            c + suffix, F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w_in), F.lit(0)))
    return out.drop("_b", *[f"_o_{c}" for c in sum_cols])
