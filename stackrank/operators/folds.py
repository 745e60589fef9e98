"""Fold assignment and fold checks.

One fold split is shared by all targets. The stratum of a customer is its number
of positive targets plus its labels on the two most frequent targets; when any
stratum has fewer rows than folds, the stratum falls back to the number of
positives alone. Inside a stratum, rows are dealt round-robin in hash order:
fold = position % k, which balances every stratum across folds to within one
row. Positions come from ``hash_positions`` (no single task per stratum).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackrank.operators.positions import hash_positions

N_FOLDS = 5
SEED = 42


def fold_salt(seed: int) -> str:
    return f"fold{seed}"


def multilabel_strata(labels: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """(customer_id, stratum STRING) by the rule above."""
    rates = labels.groupBy("target").agg(F.avg("y").alias("rate"))
    # rates has one row per target: a global window over it is bounded.
    top2 = (rates.withColumn("rk", F.row_number().over(
                Window.orderBy(F.col("rate").desc(), "target")))
                 .filter(F.col("rk") <= 2))
    per = (labels.join(F.broadcast(top2.select("target", "rk")), "target", "left")
                 .groupBy("customer_id")
                 .agg(F.sum("y").alias("npos"),
                      F.max(F.when(F.col("rk") == 1, F.col("y"))).alias("y1"),
                      F.max(F.when(F.col("rk") == 2, F.col("y"))).alias("y2")))
    per = per.withColumn("s_full", F.concat_ws("_", F.col("npos").cast("string"),
                                               F.col("y1").cast("string"),
                                               F.col("y2").cast("string")))
    # One-row flag (min stratum size < k), attached to every row by a 1-row broadcast.
    flag = (per.groupBy("s_full").count()
               .agg((F.min("count") < k).alias("fallback")))
    return per.crossJoin(F.broadcast(flag)).select(
        "customer_id",
        F.when(F.col("fallback"), F.col("npos").cast("string"))
         .otherwise(F.col("s_full")).alias("stratum"))


def assign_folds(strata: DataFrame, k: int = N_FOLDS, seed: int = SEED,
                 stratum_cols=("stratum",)) -> DataFrame:
    """(customer_id, fold INT): round-robin in hash order inside each stratum."""
    pos = hash_positions(strata, list(stratum_cols), fold_salt(seed), "customer_id")
    return pos.select("customer_id", (F.col("pos") % k).cast("int").alias("fold"))


def multilabel_folds(labels: DataFrame, k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    return assign_folds(multilabel_strata(labels, k), k, seed)


def single_target_folds(labels: DataFrame, k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """Folds stratified on one target's label, per target: (customer_id, target, fold)."""
    pos = hash_positions(labels, ["target", "y"], fold_salt(seed), "customer_id")
    return pos.select("customer_id", "target", (F.col("pos") % k).cast("int").alias("fold"))


def fold_balance(labels: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows and positives per (target, fold)."""
    return (labels.join(folds, "customer_id")
                  .groupBy("target", "fold")
                  .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                       F.sum("y").cast("bigint").alias("n_pos")))


# -- G1: greedy stratification on label combinations ---------------------------------------
SEARCHED = 2000                     # combinations that a move is sought among, per pair of folds


def combination_quotas(counts: np.ndarray, has: np.ndarray, k: int) -> np.ndarray:
    """Rows of each label combination (counts, combinations x targets ``has``) that each fold
    gets: every combination is dealt evenly, and its remainder (fewer than k rows) goes,
    combinations of the rarest targets first, to the folds that lack its targets most.
    Rows then move or change places between folds as long as that evens out the positives."""
    base, rest = np.divmod(counts, k)
    extra = np.zeros((len(counts), k), np.int64)
    rare = (counts[:, None] * has).sum(axis=0)
    total = np.zeros(k, np.int64)
    per = np.zeros((has.shape[1], k), np.int64)             # remainders by target and fold
    order = sorted(range(len(counts)), key=lambda c: (
        min([rare[t] for t in np.flatnonzero(has[c])], default=np.inf), -int(has[c].sum()), c))
    for c in order:
        mine = np.flatnonzero(has[c])
        weight = 1.0 / np.maximum(rare[mine], 1)
        lack = weight @ per[mine] if len(mine) else np.zeros(k)
        for f in sorted(range(k), key=lambda f: (lack[f], total[f], f))[:rest[c]]:
            extra[c, f] += 1
            per[mine, f] += 1
            total[f] += 1

    # a move takes a row of combination a from fold f to g, and perhaps one of b back: the
    # targets of a - b move. It helps if 2 |a - b|^2 < 2 (a - b) (per_f - per_g).
    effect = np.concatenate([has.astype(float), np.full((len(has), 1), 0.03)], axis=1)
    none = np.zeros((1, effect.shape[1]))
    while True:
        level = np.concatenate([per, 0.03 * total[None]]).astype(float)
        best = (-1e-9, None)
        for f in range(k):
            for g in range(k):
                there = np.flatnonzero((extra[:, f] == 1) & (extra[:, g] == 0))[:SEARCHED]
                back = np.flatnonzero((extra[:, g] == 1) & (extra[:, f] == 0))[:SEARCHED]
                if f == g or not len(there):
                    continue
                x, y = effect[there], np.concatenate([none, effect[back]])
                gap = level[:, f] - level[:, g]
                change = ((x ** 2).sum(axis=1)[:, None] + (y ** 2).sum(axis=1) - 2 * x @ y.T
                          - (x @ gap)[:, None] + y @ gap)
                at = np.unravel_index(np.argmin(change), change.shape)
                if change[at] < best[0]:
                    best = (change[at], (f, g, there[at[0]], back[at[1] - 1] if at[1] else None))
        if best[1] is None:
            break
        f, g, c, d = best[1]
        for row, i, j in ((c, f, g), (d, g, f)):
            if row is not None:
                extra[row, i], extra[row, j] = 0, 1
                per[:, i] -= has[row]
                per[:, j] += has[row]
                total[i] -= 1
                total[j] += 1
    return base[:, None] + extra


def greedy_folds(labels: DataFrame, k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """G1: (customer_id, fold): one split for all targets, each target's positives even over
    the folds. The greedy rule runs on the counts of label combinations (a table bounded by
    the labels, not the rows); the rows of a combination are then dealt in hash order."""
    targets = sorted(r["target"] for r in labels.select("target").distinct().collect())
    combo = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target", "y"))),
                                     lambda s: s["y"].cast("string")), "")
    per = labels.groupBy("customer_id").agg(combo.alias("combo"))
    got = per.groupBy("combo").count().orderBy("combo").collect()     # label combinations
    has = np.array([[v == "1" for v in r["combo"]] for r in got], np.int64).reshape(
        -1, len(targets))
    quotas = combination_quotas(np.array([r["count"] for r in got], np.int64), has, k)
    spark = labels.sparkSession
    ends = spark.createDataFrame(
        [(r["combo"], [int(e) for e in np.cumsum(q)]) for r, q in zip(got, quotas)],
        "combo string, ends array<long>")
    pos = hash_positions(per, ["combo"], fold_salt(seed), "customer_id")
    return pos.join(F.broadcast(ends), "combo").select(               # label combinations
        "customer_id", F.size(F.filter("ends", lambda e: e <= F.col("pos"))).alias("fold"))
