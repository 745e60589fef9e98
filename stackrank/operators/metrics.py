"""Exact ROC-AUC and label statistics as aggregations.

AUC per group = sum over positives of (negatives strictly below + half the
negatives tied) / (P * N). Equal scores are collapsed first (one row per
(group, score)), the running count of negatives comes from the skew-safe
``exclusive_running_sums``. The result is exact (not the 1000-bin MLlib
evaluator default) and null when a group has one class only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackrank.operators.positions import exclusive_running_sums

SCORE_DIGITS = 9   # scores are rounded before equal scores are grouped
AUC_DIGITS = 12
MACRO_DIGITS = 14   # means of AUCs rounded to 12 digits: two more, never on a half


def exact_auc(scored: DataFrame, group_cols, score_col: str = "score", label_col: str = "y",
              score_digits: int | None = SCORE_DIGITS,
              rows_per_bucket: int | None = None) -> DataFrame:
    """(group..., n_pos BIGINT, n_neg BIGINT, auc DOUBLE).

    ``score_digits`` rounds scores before equal scores are grouped (so summation
    noise cannot split a tie); ``None`` keeps scores computed by a fixed
    expression exactly as they are.
    """
    return auc_from_counts(collapse_scores(scored, group_cols, score_col, label_col,
                                           score_digits), group_cols, "_s", rows_per_bucket)


def collapse_scores(scored: DataFrame, group_cols, score_col: str = "score", label_col: str = "y",
                    score_digits: int | None = SCORE_DIGITS) -> DataFrame:
    """(group..., _s, p, n): positives and negatives per distinct score. Map-side
    partial aggregation makes this small when scores take few values."""
    sc = F.col(score_col).cast("double")
    if score_digits is not None:
        sc = F.round(sc, score_digits)
    y = F.col(label_col).cast("bigint")
    return scored.groupBy(*group_cols, sc.alias("_s")).agg(
        F.sum(y).alias("p"), (F.count(F.lit(1)) - F.sum(y)).alias("n"))


LOW = 1 << 24


def auc_from_counts(collapsed: DataFrame, group_cols, score_col: str = "_s",
                    rows_per_bucket: int | None = None) -> DataFrame:
    """Exact AUC from (group..., score, p, n) rows unique per (group, score).

    ``sum p (2 below + n)`` is summed in whole numbers (two halves, put together as a
    decimal), so it neither overflows nor depends on the order, up to 2^38 rows of a class.
    """
    group_cols = list(group_cols)
    from stackrank.sources.context import stored
    collapsed = stored(collapsed)            # read by the three steps of the running sums
    ranked = exclusive_running_sums(collapsed, group_cols, score_col, ["n"],
                                    rows_per_bucket=rows_per_bucket)
    v = F.col("n_below") * 2 + F.col("n")
    agg = ranked.groupBy(*group_cols).agg(
        F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"),
        F.sum(F.col("p") * F.shiftright(v, 24)).alias("_hi"),
        F.sum(F.col("p") * v.bitwiseAND(F.lit(LOW - 1).cast("bigint"))).alias("_lo"))
    whole = F.col("_hi").cast("decimal(20,0)") * F.lit(LOW).cast("decimal(10,0)") + F.col(
        "_lo").cast("decimal(20,0)")
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double") * 2
    return agg.select(
        *group_cols, F.col("n_pos").cast("bigint").alias("n_pos"),
        F.col("n_neg").cast("bigint").alias("n_neg"),
        F.round(F.try_divide(whole.cast("double"), pairs), AUC_DIGITS).alias("auc"))


GRID_BINS = 1024
GRID_ROUNDS = (GRID_BINS, 16 * GRID_BINS)   # finer bins for the points that are left
BOUND_SLACK = 1e-9        # above the rounding of AUCs and objectives


def grid_contenders(scored: DataFrame, group_cols, point: str, low: str, high: str,
                    penalty: str | None = None, bins: int = GRID_BINS) -> DataFrame:
    """(group..., point): the grid points that can have the best AUC (less ``penalty``) of
    their group.

    ``scored`` has group..., point, score, y, and the range of the scores in ``low`` and
    ``high``. Scores fall into equal bins; counts per bin, summed on the map side, bound
    each AUC from both sides (pairs of one bin count 0 or 1). A point whose upper bound
    does not reach the best lower bound cannot win, so only the others need the exact
    pass over all rows. Groups of one class keep their first point.
    """
    group_cols = list(group_cols)
    keys = [*group_cols, point]
    span = F.col(high) - F.col(low)
    b = F.coalesce(F.least(F.lit(bins - 1), F.floor(
        F.try_divide(F.col("score") - F.col(low), span) * bins)), F.lit(-1)).cast("int")
    extra = [F.max(penalty).alias("_pen")] if penalty else [F.lit(0.0).alias("_pen")]
    c = scored.groupBy(*keys, b.alias("_b")).agg(
        F.coalesce(F.sum("y"), F.lit(0)).cast("double").alias("p"),
        F.count("y").cast("double").alias("_y"),
        F.count(F.lit(1)).cast("double").alias("_all"), *extra)
    # a row without a label counts as a negative beside labelled rows of its score only: the
    # lower bound is without such rows, the upper one with them
    c = c.select(*keys, "_b", "p", (F.col("_y") - F.col("p")).alias("n"),
                 (F.col("_all") - F.col("p")).alias("m"), "_pen")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    for x in ("n", "m"):
        c = c.withColumn(f"_{x}", F.coalesce(F.sum(x).over(before), F.lit(0.0)))
    r = c.groupBy(*keys).agg(
        F.sum(F.col("p") * F.col("_n")).alias("_l"),
        F.sum(F.col("p") * (F.col("_m") + F.col("m"))).alias("_u"),
        (F.sum("p") * F.sum("m")).alias("_most"), (F.sum("p") * F.sum("n")).alias("_least"),
        F.max("_pen").alias("_pen"))
    up = F.coalesce(F.try_divide("_u", "_least"), F.lit(float("inf")))
    r = r.withColumn("_lo", F.try_divide("_l", "_most") - F.col("_pen")).withColumn(
        "_up", up - F.col("_pen"))
    w = Window.partitionBy(*group_cols)                 # one row per grid point
    r = r.withColumn("_best", F.max("_lo").over(w)).withColumn("_first", F.min(point).over(w))
    return r.where((F.col("_up") >= F.col("_best") - BOUND_SLACK)
                   | (F.col("_best").isNull() & (F.col(point) == F.col("_first")))).select(*keys)


def macro_auc(aucs: DataFrame, group_cols, auc_col: str = "auc") -> DataFrame:
    """Mean AUC over targets with both classes (null AUCs are skipped)."""
    return aucs.groupBy(*group_cols).agg(
        F.count(auc_col).cast("bigint").alias("n_scored"),
        F.round(F.avg(auc_col), MACRO_DIGITS).alias("macro_auc"))


def target_rates(labels: DataFrame) -> DataFrame:
    """Positive rate per target with null labels read as 0 (H5)."""
    return labels.groupBy("target").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.sum(F.coalesce(F.col("y"), F.lit(0))).cast("bigint").alias("n_pos"),
        F.round(F.avg(F.coalesce(F.col("y"), F.lit(0)).cast("double")), 9).alias("rate"))


def constant_targets(labels: DataFrame) -> DataFrame:
    """Targets whose label never varies (H9): (target, n_rows, n_pos, is_constant)."""
    return labels.groupBy("target").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.sum("y").cast("bigint").alias("n_pos"),
        (F.min("y") == F.max("y")).cast("int").alias("is_constant"))


def any_target(labels: DataFrame) -> DataFrame:
    """1 when a customer is positive for any target."""
    return labels.groupBy("customer_id").agg(
        (F.sum("y") > 0).cast("int").alias("y_any"))


def mean_fold_auc(fold_aucs: DataFrame, group_cols) -> DataFrame:
    """H4: per-fold AUC rows plus the mean over folds of the same group."""
    w = Window.partitionBy(*group_cols)
    return fold_aucs.withColumn("mean_fold_auc", F.round(F.avg("auc").over(w), MACRO_DIGITS))
