"""Feature profiling and selection.

Per-feature statistics run on the long layout ``(customer_id, pos, value)``:
``groupBy(pos)`` with map-side partial aggregation, so the output is one row per
feature however many rows there are. Feature lists are small DataFrames
``(feature, position)``; list arithmetic (keep, drop, order-keeping union,
intersection) is semi / anti joins and ``min(position)`` per feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackrank.functions.hashing import h_unit

# Neighbours and sampled rows of the information estimate.
MI_NEIGHBOURS, MI_ROWS = 3, 200_000
MI_DIGITS = 9


# -- variance ranking and slices ---------------------------------------------------
def variance_ranking(extra_long: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(rank, pos, feature, variance) — sample variance with null read as 0,
    ranked by variance desc then name (train rows only)."""
    v = (extra_long.filter("is_test = 0")
                   .groupBy("pos").agg(F.var_samp(F.coalesce("value", F.lit(0.0))).alias("variance")))
    ranked = v.join(dictionary, "pos")
    w = Window.orderBy(F.col("variance").desc_nulls_last(), "feature")  # one row per feature
    return ranked.select(F.row_number().over(w).cast("int").alias("rank"), "pos", "feature",
                         F.col("variance").cast("float").alias("variance"))


def take_slice(ranked: DataFrame, top_k: int = 0, start: int = 0, size: int = 0,
               drop: DataFrame | None = None) -> DataFrame:
    """Keep ranks in [start, start+size) of the first top_k; then drop-list
    (applied after slicing, so blocks shrink rather than refill)."""
    r = ranked
    if top_k > 0:
        r = r.filter(F.col("rank") <= top_k)
    r = r.filter(F.col("rank") > start)
    if size > 0:
        r = r.filter(F.col("rank") <= start + size)
    if drop is not None:
        r = r.join(drop, "feature", "left_anti")
    return r


# -- distinct counts -----------------------------------------------------------------
def distinct_counts(extra_long: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(pos, feature, n_unique): distinct non-null values over train and test."""
    d = extra_long.groupBy("pos").agg(F.count_distinct("value").alias("n_unique"))
    return d.join(dictionary, "pos").select("pos", "feature",
                                            F.col("n_unique").cast("bigint").alias("n_unique"))


def few_distinct(mart: DataFrame, dictionary: DataFrame, cap: int = 50,
                 block: str = "extra") -> DataFrame:
    """(pos, feature, n_unique) of the features of an ARRAY<DOUBLE> with at most ``cap`` distinct
    non-null values (NaN is one value, the zeros are one). A task keeps a set of values per
    feature and gives the feature up when it holds more than ``cap``, so the values of a
    continuous feature are never sent; at most ``cap`` + 1 rows leave a task per feature."""
    def run(batches):
        seen: dict[int, set] = {}
        over: set[int] = set()
        for b in batches:
            col = b.column("x")
            n = b.num_rows
            flat = col.flatten()
            width = len(flat) // n if n else 0
            null = flat.is_null().to_numpy(zero_copy_only=False).reshape(n, width)
            x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, width) + 0.0
            for j in range(width):
                if j not in over:
                    got = seen.setdefault(j, set())
                    got.update(np.unique(x[~null[:, j], j]).view(np.int64).tolist())
                    if len(got) > cap:
                        over.add(j)
                        del seen[j]
        rows = [(j, v) for j, s in seen.items() for v in s] + [(j, None) for j in over]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())],
            names=["pos", "bits"])

    parts = mart.select(F.col(block).alias("x")).where(F.size("x") > 0).mapInArrow(
        run, "pos int, bits long")
    counts = parts.groupBy("pos").agg(F.countDistinct("bits").alias("n_unique"),
                                      F.count_if(F.col("bits").isNull()).alias("_over"))
    return (counts.where((F.col("_over") == 0) & (F.col("n_unique") <= cap))
            .join(F.broadcast(dictionary), "pos")                     # one row per feature
            .select("pos", "feature", F.col("n_unique").cast("bigint").alias("n_unique")))


def pseudo_categorical(counts: DataFrame, min_unique: int = 2, max_unique: int = 50) -> DataFrame:
    """Features whose distinct count lies in [min, max] (listed by name)."""
    return counts.filter((F.col("n_unique") >= min_unique) & (F.col("n_unique") <= max_unique))


def lowest_unique(pseudo: DataFrame, n: int) -> DataFrame:
    """E5: the n pseudo-categoricals with fewest distinct values (ties by name)."""
    w = Window.orderBy("n_unique", "feature")
    return (pseudo.withColumn("rank", F.row_number().over(w).cast("int"))
                  .filter(F.col("rank") <= n))


def ordered_union(*lists: DataFrame) -> DataFrame:
    """Order-keeping de-duplicating union of (feature, position) lists."""
    tagged = None
    for i, l in enumerate(lists):
        t = l.select("feature", F.struct(F.lit(i).alias("l"), F.col("position").alias("p")).alias("k"))
        tagged = t if tagged is None else tagged.unionByName(t)
    first = tagged.groupBy("feature").agg(F.min("k").alias("k"))
    w = Window.orderBy("k")
    return first.select("feature", (F.row_number().over(w) - 1).cast("int").alias("position"))


# -- mutual information ------------------------------------------------------------------
def numeric_values(mart: DataFrame, names: list, values) -> DataFrame:
    """(customer_id, feature, x) of an ARRAY<DOUBLE> column ``values`` with ``names``: null read
    as 0, plus a jitter of up to 1e-10 of the feature's largest magnitude from a hash of
    (feature, id), so that no two rows are equal and reruns agree."""
    spark = mart.sparkSession
    dic = spark.createDataFrame(list(enumerate(names)), "pos INT, feature STRING")
    long = (mart.select("customer_id", F.posexplode(values).alias("pos", "v"))
            .join(F.broadcast(dic), "pos")                           # one row per feature
            .select("customer_id", "feature", F.coalesce("v", F.lit(0.0)).alias("v")))
    top = long.groupBy("feature").agg(F.max(F.abs("v")).alias("top"))
    return long.join(F.broadcast(top), "feature").select(            # one row per feature
        "customer_id", "feature",
        (F.col("v") + F.lit(1e-10) * F.greatest(F.lit(1.0), "top")
         * h_unit("mi", "feature", "customer_id")).alias("x"))


def digamma(n: int) -> np.ndarray:
    """digamma(0..n) of whole numbers (0 at 0): harmonic numbers less Euler's constant."""
    out = np.zeros(n + 1)
    out[1:] = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, n))]) - np.euler_gamma
    return out


def neighbour_information(x: np.ndarray, y: np.ndarray, k: int = MI_NEIGHBOURS) -> float:
    """Mutual information (nats) of a number and a class by nearest neighbours: the distance
    to the k-th neighbour within the class, against how many of all rows are nearer."""
    n_class = np.bincount(y, minlength=2)
    ok = n_class[y] > 1
    x, y = x[ok], y[ok]
    if not len(x):
        return 0.0
    everything = np.sort(x)
    psi = digamma(len(x))
    total = 0.0
    for c in np.unique(y):
        v = np.sort(x[y == c])
        kk = min(k, len(v) - 1)
        far = np.full((2 * kk, len(v)), np.inf)
        for j in range(1, kk + 1):
            far[2 * j - 2, j:] = v[j:] - v[:-j]
            far[2 * j - 1, :-j] = v[j:] - v[:-j]
        r = np.sort(far, axis=0)[kk - 1]
        near = (np.searchsorted(everything, v + r, "left")
                - np.searchsorted(everything, v - r, "right"))
        total += len(v) * (psi[kk] - psi[len(v)]) - psi[np.maximum(near, 1)].sum()
    return max(0.0, float(psi[len(x)] + total / len(x)))


def numeric_information(values: DataFrame, labels: DataFrame) -> DataFrame:
    """E7 for numbers: (target, feature, mi). ``values`` are those of a bounded sample of
    customers; a feature's values and labels (a byte per target) are one group, whose size
    the sample bounds."""
    targets = sorted(r["target"] for r in labels.select("target").distinct().collect())
    ys = labels.groupBy("customer_id").agg(F.array(*[
        F.max(F.when(F.col("target") == t, F.col("y"))) for t in targets]).alias("ys"))

    def run(key, table):
        x = table["x"].to_numpy()
        y = table["ys"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(
            len(x), -1)
        return pa.table({"target": targets, "feature": [key[0].as_py()] * len(targets),
                         "mi": [neighbour_information(x, y[:, j].astype(np.int64))
                                for j in range(len(targets))]})

    return values.join(ys, "customer_id").groupBy("feature").applyInArrow(
        run, "target string, feature string, mi double")


def category_values(mart: DataFrame, cat_cols) -> DataFrame:
    """(customer_id, feature, bin STRING) of the categories by value."""
    return mart.select("customer_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias("bin"))
        for c in cat_cols])).alias("s")).select("customer_id", "s.feature", "s.bin")


def category_information(binned: DataFrame, labels: DataFrame) -> DataFrame:
    """E7 for categories: plug-in MI in nats, (target, feature, mi).

    Only positive labels are joined to the values (positives are sparse); the y=0
    cell of a value is its total minus its positives. MI = sum over cells of
    n/N * ln(n*N / (n_bin * n_class)).
    """
    n_b = binned.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("nb"))
    pos = (labels.filter("y = 1").select("customer_id", "target")
                 .join(binned, "customer_id")
                 .groupBy("target", "feature", "bin").agg(F.count(F.lit(1)).alias("nb1")))
    cells = (n_b.crossJoin(F.broadcast(class_sizes(labels)))   # one row per target: bounded
                .join(pos, ["target", "feature", "bin"], "left")
                .withColumn("nb1", F.coalesce("nb1", F.lit(0)))
                .withColumn("nb0", F.col("nb") - F.col("nb1"))
                .withColumn("N0", F.col("N") - F.col("N1")))

    def term(nc, ncls):
        return F.when(F.col(nc) > 0, F.col(nc) / F.col("N") * F.log(
            F.col(nc) * F.col("N") / (F.col("nb") * F.col(ncls)))).otherwise(F.lit(0.0))

    return (cells.groupBy("target", "feature")
                 .agg(F.sum(term("nb1", "N1") + term("nb0", "N0")).alias("mi")))


def class_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("target").agg(F.count(F.lit(1)).alias("N"), F.sum("y").alias("N1"))


def mi_topk(mi: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(target, rank, feature): top k by MI (ties by name); a constant target takes
    the first k of the pool in pool order."""
    j = mi.join(pool, "feature")
    const = (F.col("N1") == 0) | (F.col("N1") == F.col("N"))
    w = Window.partitionBy("target").orderBy(
        F.when(const, F.lit(0.0)).otherwise(-F.round("mi", MI_DIGITS)),
        F.when(const, F.col("position")).otherwise(F.lit(0)), "feature")
    return (j.withColumn("rank", F.row_number().over(w).cast("int"))
             .filter(F.col("rank") <= k).select("target", "rank", "feature"))


def union_cap(top: DataFrame, cap: int, fallback_n: int = 64) -> DataFrame:
    """Rank the union by (targets selecting it desc, mean 0-based rank, name),
    keep ``cap``; each target keeps its selected features inside the cap, or the
    first ``fallback_n`` of the union ranking when none survives.
    Returns (target, feature, position) ordered per target."""
    stats = top.groupBy("feature").agg(F.count(F.lit(1)).alias("freq"),
                                       F.avg(F.col("rank") - 1).alias("mean_rank"))
    w = Window.orderBy(F.col("freq").desc(), "mean_rank", "feature")
    ranked = stats.withColumn("urank", F.row_number().over(w))
    keep = ranked.filter(F.col("urank") <= cap).select("feature")
    kept = top.join(F.broadcast(keep), "feature", "left_semi")
    empty = top.select("target").distinct().join(kept.select("target").distinct(), "target",
                                                  "left_anti")
    fallback = (empty.crossJoin(F.broadcast(
        ranked.filter(F.col("urank") <= fallback_n).select("feature", F.col("urank").alias("rank"))))
        .select("target", "feature", "rank"))
    return kept.select("target", "feature", "rank").unionByName(fallback)
