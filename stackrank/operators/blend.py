"""Weight-grid blending of prediction sources.

One plan scores all targets at once: ``target`` is a grouping key, not a loop.

1. rank-normalise each (split, target, source) group (skew-safe);
2. pivot the blend's sources into columns per (target, customer) — a fixed,
   known source list, so a conditional aggregation rather than a dynamic pivot;
3. the rows are packed, and tasks blend them for every grid point (the grid's size is
   fixed by the number of sources and the step, never by the data); counts in score
   bins bound the AUC of every grid point, and most points drop out;
4. exact AUC of the points that are left, first-wins argmax on the rounded AUC.

A constant target keeps uniform weights and a null AUC, and its blend is the
uniform mean of the *raw* scores (as the reference does).
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackrank.operators.blends import Blends
from stackrank.operators.metrics import AUC_DIGITS, GRID_ROUNDS
from stackrank.operators.rank import rank_normalize

STEP = 0.05
SCORE_DIGITS = 9


def grid_units(step: float) -> int:
    return int(round(1.0 / step))


def simplex_grid(spark: SparkSession, n: int, step: float = STEP) -> DataFrame:
    """L1: (grid_id INT, u_0..u_{n-1} INT, w_0..w_{n-1} DOUBLE), lexicographic order.

    The grid is generated by Spark (``sequence`` + ``explode`` per dimension, filtered
    on the running sum); the last weight takes what is left. grid_id starts at 1.
    """
    units = grid_units(step)
    df = spark.range(1).select(F.lit(0).alias("_z"))
    for i in range(n - 1):
        used = sum((F.col(f"u_{j}") for j in range(i)), F.lit(0))
        df = df.withColumn(f"u_{i}", F.explode(F.sequence(F.lit(0), F.lit(units) - used)))
    used = sum((F.col(f"u_{j}") for j in range(n - 1)), F.lit(0))
    df = df.withColumn(f"u_{n - 1}", (F.lit(units) - used).cast("int"))
    order = [F.col(f"u_{i}") for i in range(n)]
    # The grid is bounded (C(units+n-1, n-1) rows): one window over it is fine.
    df = df.withColumn("grid_id", F.row_number().over(Window.orderBy(*order)).cast("int"))
    return df.select("grid_id", *[F.col(f"u_{i}").cast("int").alias(f"u_{i}") for i in range(n)],
                     *[(F.col(f"u_{i}").cast("double") / units).alias(f"w_{i}") for i in range(n)])


def simplex_grid_size(n: int, step: float = STEP) -> int:
    units = grid_units(step)
    return sum(1 for _ in itertools.combinations(range(units + n - 1), n - 1))


def _pivot_sources(preds: DataFrame, sources, value: str) -> DataFrame:
    return preds.groupBy("target", "customer_id").agg(*[
        F.max(F.when(F.col("source") == s, F.col(value))).alias(f"r_{i}")
        for i, s in enumerate(sources)])


def _blend_expr(n: int, prefix: str = "w_") -> F.Column:
    expr = F.col(f"{prefix}0") * F.col("r_0")
    for i in range(1, n):
        expr = expr + F.col(f"{prefix}{i}") * F.col(f"r_{i}")
    return expr


def blend_search(spark: SparkSession, preds: DataFrame, labels: DataFrame, sources,
                 step: float = STEP, use_rank: bool = True) -> DataFrame:
    """L2 search: (target, grid_id, w_0..w_{n-1}, auc) — the best grid point per target."""
    sources = list(sources)
    n = len(sources)
    oof = preds.filter((F.col("split") == "oof") & F.col("source").isin(sources))
    if use_rank:
        oof = rank_normalize(oof, ["split", "target", "source"], "score", out="r")
    else:
        oof = oof.withColumn("r", F.col("score"))
    wide = _pivot_sources(oof, sources, "r").join(labels, ["target", "customer_id"])
    grid = simplex_grid(spark, n, step)
    own = [(g["grid_id"], [g[f"w_{i}"] for i in range(n)]) for g in grid.collect()]    # bounded
    points = {r["target"]: own for r in labels.select("target").distinct().collect()}
    lost = reduce(lambda a, b: a | b, [F.col(f"r_{i}").isNull() for i in range(n)])
    rows = Blends(wide, points, [f"r_{i}" for i in range(n)], lost, SCORE_DIGITS)
    # bounds of all points by counts in bins, then the exact AUC of those that can win
    for bins in GRID_ROUNDS:
        points = rows.contenders(points, bins, lambda t, i: 0.0)
    aucs = rows.aucs(points).withColumnRenamed("point", "grid_id") if points else \
        spark.createDataFrame([], "target string, grid_id int, auc double")
    w = Window.partitionBy("target").orderBy(F.col("auc").desc_nulls_last(), "grid_id")
    best = (aucs.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1")
                .join(F.broadcast(grid), "grid_id"))
    uniform = 1.0 / n
    const = F.col("auc").isNull()
    return best.select(
        "target",
        F.when(const, F.lit(None).cast("int")).otherwise(F.col("grid_id")).alias("grid_id"),
        *[F.when(const, F.lit(uniform)).otherwise(F.col(f"w_{i}")).alias(f"w_{i}")
          for i in range(n)],
        F.round("auc", AUC_DIGITS).alias("auc"))


def blend_apply(preds: DataFrame, best: DataFrame, sources, split: str = "test",
                use_rank: bool = True) -> DataFrame:
    """L2 apply: (customer_id, target, score) with the chosen weights.

    Targets without a grid point (constant) average the raw scores uniformly.
    """
    sources = list(sources)
    n = len(sources)
    part = preds.filter((F.col("split") == split) & F.col("source").isin(sources))
    ranked = (rank_normalize(part, ["split", "target", "source"], "score", out="r")
              if use_rank else part.withColumn("r", F.col("score")))
    wide = ranked.groupBy("target", "customer_id").agg(*[
        F.max(F.when(F.col("source") == s, F.col(c))).alias(f"{name}_{i}")
        for i, s in enumerate(sources) for c, name in (("r", "r"), ("score", "raw"))])
    raw_mean = sum((F.col(f"raw_{i}") for i in range(n)), F.lit(0.0)) / n
    j = wide.join(F.broadcast(best), "target")
    # The uniform mean is left unrounded: both engines compute the same IEEE value,
    # while rounding a mean of 9-digit scores would sit on exact halves.
    return j.select(
        "customer_id", "target",
        F.when(F.col("grid_id").isNull(), raw_mean)
         .otherwise(F.round(_blend_expr(n), SCORE_DIGITS)).alias("score"))


def rank_blend_fixed(preds: DataFrame, sources, weights, split: str = "test") -> DataFrame:
    """L3: fixed-weight blend of average-rank / n transforms (e.g. 0.75/0.25)."""
    from stackrank.operators.rank import rank_average
    sources = list(sources)
    part = preds.filter((F.col("split") == split) & F.col("source").isin(sources))
    ranked = rank_average(part, ["split", "target", "source"], "score", out="ra")
    wide = _pivot_sources(ranked, sources, "ra")
    expr = F.lit(float(weights[0])) * F.col("r_0")
    for i in range(1, len(sources)):
        expr = expr + F.lit(float(weights[i])) * F.col(f"r_{i}")
    return wide.select("customer_id", "target", F.round(expr, SCORE_DIGITS).alias("score"))
