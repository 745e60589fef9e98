"""Feature encoders.

Target encoding is one aggregation for all columns and folds at once:
``groupBy(group, value, fold)`` -> (sum y, n); the leave-fold-out statistic of a
fold is the total over all folds minus the fold itself, so the OOF mapping of
every fold comes out of a single shuffle instead of one job per (column, fold).
The global mean is taken over all train rows (the held-out fold included, as
the reference defines it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 20.0
MISSING = "__MISSING__"


def smoothed_stats(train: DataFrame, group_cols, alpha: float = ALPHA):
    """Per (group, value, fold) sums, and per group the global mean.

    ``train`` has: group cols, ``value``, ``fold``, ``y``.
    Returns (stats, gm): stats = group, value, fold, sy, n, ty, tn; gm = group, gm.
    """
    group_cols = list(group_cols)
    stats = train.groupBy(*group_cols, "value", "fold").agg(
        F.sum("y").cast("double").alias("sy"), F.count(F.lit(1)).cast("double").alias("n"))
    return stats_of_sums(stats, group_cols)


def stats_of_sums(stats: DataFrame, group_cols):
    """``smoothed_stats`` from (group, value, fold, sy, n)."""
    group_cols = list(group_cols)
    w = Window.partitionBy(*group_cols, "value")
    stats = stats.withColumn("ty", F.sum("sy").over(w)).withColumn("tn", F.sum("n").over(w))
    gm = stats.groupBy(*group_cols).agg((F.sum("sy") / F.sum("n")).alias("gm"))
    return stats, gm


def smoothed_mapping(train: DataFrame, group_cols, alpha: float = ALPHA) -> DataFrame:
    """(group, value, n, enc) with enc = (mean*n + gm*alpha) / (n + alpha)."""
    group_cols = list(group_cols)
    agg = train.groupBy(*group_cols, "value").agg(
        F.sum("y").cast("double").alias("sy"), F.count(F.lit(1)).cast("double").alias("n"))
    gm = train.groupBy(*group_cols).agg(F.avg(F.col("y").cast("double")).alias("gm"))
    return agg.join(gm, group_cols).select(
        *group_cols, "value", F.col("n").cast("bigint").alias("n"),
        ((F.col("sy") + F.col("gm") * alpha) / (F.col("n") + alpha)).alias("enc"),
        "gm")


def encodings(stats: DataFrame, group_cols, alpha: float = ALPHA):
    """From ``smoothed_stats`` joined with the means: (group, value, fold, enc_oof) without
    the fold and (group, value, enc_full) over all folds."""
    group_cols = list(group_cols)
    oof_map = stats.select(
        *group_cols, "value", "fold",
        (((F.col("ty") - F.col("sy")) + F.col("gm") * alpha)
         / ((F.col("tn") - F.col("n")) + alpha)).alias("enc_oof"))
    full_map = (stats.groupBy(*group_cols, "value")
                     .agg(F.sum("sy").alias("ty"), F.sum("n").alias("tn"), F.first("gm").alias("gm"))
                     .select(*group_cols, "value",
                             ((F.col("ty") + F.col("gm") * alpha) / (F.col("tn") + alpha))
                             .alias("enc_full")))
    return oof_map, full_map


def oof_target_encoding(train: DataFrame, test: DataFrame | None, group_cols,
                        alpha: float = ALPHA):
    """D5 + D6.

    train: customer_id, group cols, value, fold, y  -> customer_id, group, enc
    test:  customer_id, group cols, value           -> customer_id, group, enc
    Rows whose value is null or unseen get the group's global mean.
    """
    group_cols = list(group_cols)
    stats, gm = smoothed_stats(train, group_cols, alpha)
    oof_map, full_map = encodings(stats.join(gm, group_cols), group_cols, alpha)
    tr = (train.join(oof_map, [*group_cols, "value", "fold"], "left")
               .join(F.broadcast(gm), group_cols)       # one row per group
               .select("customer_id", *group_cols,
                       F.coalesce("enc_oof", "gm").alias("enc")))
    if test is None:
        return tr, None
    te = (test.join(full_map, [*group_cols, "value"], "left")
              .join(F.broadcast(gm), group_cols)
              .select("customer_id", *group_cols, F.coalesce("enc_full", "gm").alias("enc")))
    return tr, te


def category_codes(values: DataFrame, missing: str = MISSING) -> DataFrame:
    """D3: joint codes over train + test per feature; null is its own value.

    ``values``: customer_id, feature, value (any type). Codes follow first
    appearance, defined as the smallest customer_id holding the value (ties by
    value text). Returns customer_id, feature, value_text, code INT.
    """
    from stackrank.operators.positions import exclusive_running_sums
    v = values.select("customer_id", "feature",
                      F.coalesce(F.col("value").cast("string"), F.lit(missing)).alias("value_text"))
    # A customer holds one value per feature, so first_id is unique per (feature,
    # value): the code is the number of values that appeared earlier — a skew-safe
    # running count, not one window over every distinct value of a feature.
    first = v.groupBy("feature", "value_text").agg(F.min("customer_id").alias("first_id"),
                                                   F.lit(1).alias("one"))
    codes = exclusive_running_sums(first, ["feature"], "first_id", ["one"]).select(
        "feature", "value_text", F.col("one_below").cast("int").alias("code"))
    return v.join(codes, ["feature", "value_text"])


def numeric_coerce(col):
    """Text or number to FLOAT; unparsable values become null (never raise)."""
    return F.expr(f"try_cast({col} AS FLOAT)") if isinstance(col, str) else col.try_cast("float")


def quantize(df: DataFrame, cols, decimals) -> DataFrame:
    """C4: add <c>_q<d> = half-even rounding of c to d decimals."""
    out = df
    for c in cols:
        for d in decimals:
            out = out.withColumn(f"{c}_q{d}", F.bround(F.col(c).cast("double"), d))
    return out


def exact_median(long_df: DataFrame, group_cols=("pos",), value: str = "value") -> DataFrame:
    """(group..., med): exact median of the non-null values per group (the mean of the
    two middle values for an even count, as ``quantile_cont(0.5)``).

    Built from distributed pieces instead of the ``median`` aggregate (which keeps
    every distinct value of a group in one task's memory): counts per distinct
    value, skew-safe running counts below each value, then the value(s) whose rank
    range holds the middle rank(s).
    """
    from stackrank.operators.positions import exclusive_running_sums
    group_cols = list(group_cols)
    c = (long_df.filter(F.col(value).isNotNull())
                .groupBy(*group_cols, value).agg(F.count(F.lit(1)).alias("c")))
    below = exclusive_running_sums(c, group_cols, value, ["c"])
    n = c.groupBy(*group_cols).agg(F.sum("c").alias("_n"))
    j = below.join(F.broadcast(n), group_cols).withColumn("_k1", F.floor((F.col("_n") - 1) / 2)) \
             .withColumn("_k2", F.ceil((F.col("_n") - 1) / 2))
    hit = lambda k: (F.col("c_below") <= F.col(k)) & (F.col(k) < F.col("c_below") + F.col("c"))
    return j.groupBy(*group_cols).agg(
        ((F.max(F.when(hit("_k1"), F.col(value))) + F.max(F.when(hit("_k2"), F.col(value)))) / 2.0)
        .alias("med"))


def median_impute_long(long_df: DataFrame, group_cols=("pos",), value: str = "value",
                       fit: DataFrame | None = None) -> DataFrame:
    """D8 on the long layout: null -> exact median per feature of the non-null values of
    ``fit`` (the training rows; default all)."""
    group_cols = list(group_cols)
    med = exact_median(long_df if fit is None else fit, group_cols, value).withColumnRenamed(
        "med", "_med")
    return (long_df.join(F.broadcast(med), group_cols, "left")   # one row per feature
                   .withColumn(value, F.coalesce(F.col(value), F.col("_med")))
                   .drop("_med"))


def standardize_long(long_df: DataFrame, group_cols=("pos",), value: str = "value",
                     with_mean: bool = True, fit: DataFrame | None = None) -> DataFrame:
    """D9 on the long layout: (x - mean) / population std (scikit-learn's scaling), both
    from the rows of ``fit`` (the training rows; default all).

    A zero deviation divides by 1, as scikit-learn does.
    """
    group_cols = list(group_cols)
    st = (long_df if fit is None else fit).groupBy(*group_cols).agg(F.avg(value).alias("_mu"),
                                          F.stddev_pop(value).alias("_sd"))
    centre = F.col("_mu") if with_mean else F.lit(0.0)
    scale = F.when((F.col("_sd").isNull()) | (F.col("_sd") == 0), F.lit(1.0)).otherwise(
        F.col("_sd"))
    return (long_df.join(F.broadcast(st), group_cols)           # one row per feature
                   .withColumn(value, (F.col(value) - centre) / scale)
                   .drop("_mu", "_sd"))
