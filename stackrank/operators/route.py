"""Per-target routing over many prediction sources.

One plan for all targets:

1. exact AUC per (target, source) on OOF rows (partial sources simply have no
   rows for the targets they skip);
2. order per target by (AUC desc, manifest position); constant targets keep the
   manifest order (their AUC is null);
3. candidate pool: gap to the best <= delta (best always kept, at least the
   mode's width), then the cap (not below the width);
4. weights per mode — winner, top-2, top-3 (fixed weights), or a bounded,
   regularised grid search — as a small table (targets x width rows);
5. the routed score is one weighted ``sum`` over the long predictions joined to
   that table (broadcast: its size is bounded by targets x 3).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackrank.operators.blend import grid_units, simplex_grid
from stackrank.operators.blends import Blends
from stackrank.operators.metrics import AUC_DIGITS, GRID_ROUNDS, exact_auc

# Default fixed weights of the top-2 and top-3 modes.
TOP2_WEIGHTS = (0.65, 0.35)
TOP3_WEIGHTS = (0.45, 0.35, 0.20)
MODE_WIDTH = {"winner": 1, "top2_weighted": 2, "top3_weighted": 3, "optimize_weights": 1}
OPT_ALPHA, OPT_MIN_W, OPT_MAX_W = 0.1, 0.01, 0.99


def normalise_weights(spark: SparkSession, weights, width: int) -> DataFrame:
    """C11: (width, rank, weight) with non-negative weights divided by their sum."""
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    df = spark.createDataFrame([(width, i + 1, float(w)) for i, w in enumerate(weights)],
                               "width INT, rank INT, w DOUBLE")
    return df.select("width", "rank", F.round(F.col("w") / F.sum("w").over(Window.partitionBy(
        "width")), 12).alias("weight"))


def weight_table(spark: SparkSession, mode: str, top2=TOP2_WEIGHTS, top3=TOP3_WEIGHTS) -> DataFrame:
    """(n_avail, rank, weight): weights by the number of sources actually available."""
    one = spark.createDataFrame([(1, 1, 1.0)], "width INT, rank INT, weight DOUBLE")
    if mode == "winner":
        return one
    t2 = normalise_weights(spark, top2, 2)
    if mode == "top2_weighted":
        return one.unionByName(t2)
    if mode == "top3_weighted":
        return one.unionByName(t2).unionByName(normalise_weights(spark, top3, 3))
    raise ValueError(mode)


def source_aucs(aucs: DataFrame, labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """(target, source, position, auc, is_constant, order): per-target source order, from the
    AUC of every (target, source)."""
    aucs = aucs.select("target", "source", "auc")
    const = labels.groupBy("target").agg((F.min("y") == F.max("y")).alias("is_constant"))
    j = aucs.join(F.broadcast(manifest), "source").join(const, "target")
    w = Window.partitionBy("target").orderBy(
        F.when(F.col("is_constant"), F.lit(None)).otherwise(F.col("auc")).desc_nulls_last(),
        "position")
    return j.withColumn("ord", F.row_number().over(w).cast("int"))


def candidate_pool(ordered: DataFrame, mode: str, delta: float = 0.0, cap: int = 0) -> DataFrame:
    """L7 + L8: rows of ``ordered`` kept in the pool (same columns)."""
    width = MODE_WIDTH[mode]
    wt = Window.partitionBy("target")
    d = ordered.withColumn("_n", F.count(F.lit(1)).over(wt)).withColumn(
        "_best", F.max(F.when(F.col("ord") == 1, F.col("auc"))).over(wt))
    min_keep = F.least(F.lit(width), F.col("_n"))
    if delta > 0:
        gap_ok = (F.col("_best") - F.col("auc")) <= F.lit(delta)
        d = d.withColumn("_keep", F.col("is_constant") | (F.col("ord") == 1) | gap_ok)
        kept = F.sum(F.col("_keep").cast("int")).over(wt)
        # Fewer than the mode's width survive: take the first `width` instead.
        d = d.withColumn("_keep", F.when(kept < min_keep, F.col("ord") <= min_keep)
                         .otherwise(F.col("_keep")))
    else:
        d = d.withColumn("_keep", F.lit(True))
    d = d.filter("_keep")
    if cap > 0:
        d = d.withColumn("_pn", F.count(F.lit(1)).over(wt))
        max_n = F.greatest(F.lit(cap), F.least(F.lit(width), F.col("_pn")))
        d = d.withColumn("_prank", F.row_number().over(wt.orderBy("ord"))).filter(
            F.col("_prank") <= max_n).drop("_pn", "_prank")
    return d.drop("_n", "_best", "_keep")


def fixed_mode_weights(spark: SparkSession, pool: DataFrame, mode: str) -> DataFrame:
    """(target, source, rank, weight) for winner / top-2 / top-3."""
    width = MODE_WIDTH[mode]
    w = Window.partitionBy("target").orderBy("ord")
    top = pool.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= width)
    n_avail = top.groupBy("target").agg(F.count(F.lit(1)).cast("int").alias("width"))
    table = weight_table(spark, mode)
    return (top.join(n_avail, "target")
               .join(F.broadcast(table), ["width", "rank"])
               .select("target", "source", "rank", "weight"))


def optimized_weights(spark: SparkSession, pool: DataFrame, oof: DataFrame, labels: DataFrame,
                      step: float = 0.05, alpha: float = OPT_ALPHA, min_w: float = OPT_MIN_W,
                      max_w: float = OPT_MAX_W) -> DataFrame:
    """L9 + L10 (re-aimed): maximise AUC - alpha * sum((w - 1/n)^2) over the simplex
    grid restricted to [min_w, max_w] (feasible by construction), per target.

    The pool's scores are pivoted into rank columns r_1..r_m per (target, id) and packed
    (``Blends``): tasks bound the AUC of every grid point of the pool's width and take the
    exact AUC of those that can still win. A one-source pool takes weight 1
    (the bounds cannot hold for it); constant targets get uniform weights. The width is
    that of the widest pool (``candidate_pool``'s cap keeps it small: the grid has
    C(1/step + width - 1, width - 1) points); all rows take part.
    """
    from stackrank.sources.context import cut
    max_width = pool.groupBy("target").count().agg(F.max("count")).first()[0] or 1
    for n in range(2, max_width + 1):   # L10: bounds must admit weights summing to 1
        if n * min_w > 1 + 1e-12 or n * max_w < 1 - 1e-12:
            raise ValueError(f"infeasible weight bounds [{min_w}, {max_w}] for {n} sources")
    r = pool.withColumn("rank", F.row_number().over(
        Window.partitionBy("target").orderBy("ord")).cast("int"))
    widths = r.groupBy("target").agg(F.count(F.lit(1)).cast("int").alias("width"),
                                     F.first("is_constant").alias("is_constant"))
    grids = []
    for n in range(1, max_width + 1):
        g = simplex_grid(spark, n, step)
        ok = F.lit(True)
        if n > 1:
            for i in range(n):
                ok = ok & (F.col(f"w_{i}") >= min_w - 1e-12) & (F.col(f"w_{i}") <= max_w + 1e-12)
        g = g.filter(ok)
        pen = sum((F.pow(F.col(f"w_{i}") - 1.0 / n, 2) for i in range(n)), F.lit(0.0))
        grids.append(g.select(F.lit(n).alias("width"), "grid_id", *[
            (F.col(f"w_{i}") if i < n else F.lit(0.0)).alias(f"g_{i + 1}")
            for i in range(max_width)], pen.alias("pen")))
    grid = grids[0]
    for g in grids[1:]:
        grid = grid.unionByName(g)
    rows = oof.join(F.broadcast(r.select("target", "source", "rank")),    # targets x sources
                    ["target", "source"])
    wide = (rows.groupBy("target", "customer_id")
                .agg(*[F.max(F.when(F.col("rank") == i, F.col("score"))).alias(f"r_{i}")
                       for i in range(1, max_width + 1)])
                .join(labels, ["target", "customer_id"])
                .join(F.broadcast(widths.filter(~F.col("is_constant")).select("target")),
                      "target"))                        # a row per target
    # Grid sizes are fixed by (width, step): bounded.
    of_width: dict = {}
    for g in grid.collect():
        of_width.setdefault(g["width"], {})[g["grid_id"]] = (
            [g[f"g_{i}"] for i in range(1, g["width"] + 1)], alpha * g["pen"])
    sizes = {x["target"]: x["width"] for x in widths.filter(~F.col("is_constant")).collect()}
    points = {t: [(i, w) for i, (w, _) in of_width[n].items()] for t, n in sizes.items()}
    if points:
        rows = Blends(wide, points, [f"r_{i}" for i in range(1, max_width + 1)],
                      lost=F.col("r_1").isNull())
        for bins in GRID_ROUNDS:
            points = rows.contenders(points, bins, lambda t, i: of_width[sizes[t]][i][1])
    if points:
        aucs = cut(rows.aucs(points)).withColumnRenamed("point", "grid_id")
    else:
        aucs = spark.createDataFrame([], "target string, grid_id int, auc double")
    obj = (aucs.join(widths.select("target", "width"), "target")
               .join(F.broadcast(grid.select("width", "grid_id", "pen")), ["width", "grid_id"])
               .withColumn("objective",
                           F.round(F.col("auc") - F.lit(alpha) * F.col("pen"), AUC_DIGITS)))
    best = (obj.withColumn("_r", F.row_number().over(Window.partitionBy("target").orderBy(
        F.col("objective").desc_nulls_last(), "grid_id"))).filter("_r = 1")
        .join(F.broadcast(grid.drop("pen")), ["width", "grid_id"]))
    chosen = r.join(best, "target").select(
        "target", "source", "rank",
        F.element_at(F.array(*[F.col(f"g_{i}") for i in range(1, max_width + 1)]),
                     F.col("rank")).alias("weight"))
    uniform = (r.join(widths.filter(F.col("is_constant")), "target")
                .select("target", "source", "rank", (F.lit(1.0) / F.col("width")).alias("weight")))
    return chosen.unionByName(uniform)


def bounded_projection(w, lo: float, hi: float):
    """The nearest point to ``w`` with lo <= w_i <= hi and sum 1: clip(w - t), t by
    bisection (the sum falls as t rises). Bounds that admit no such point are an error."""
    w = np.asarray(w, float)
    if len(w) * lo > 1 + 1e-12 or len(w) * hi < 1 - 1e-12:
        raise ValueError(f"infeasible weight bounds [{lo}, {hi}] for {len(w)} sources")
    a, b = w.min() - hi, w.max() - lo
    for _ in range(100):
        t = (a + b) / 2
        if np.clip(w - t, lo, hi).sum() > 1:
            a = t
        else:
            b = t
    return np.clip(w - (a + b) / 2, lo, hi)


# Weight moved between two sources, halved from round to round.
MOVES = (0.05, 0.025, 0.0125, 0.00625, 0.003125)


def refined_weights(start: DataFrame, oof: DataFrame, labels: DataFrame, moves=MOVES,
                    alpha: float = OPT_ALPHA, min_w: float = OPT_MIN_W,
                    max_w: float = OPT_MAX_W) -> DataFrame:
    """L9 + L10: (target, source, rank, weight, objective) from ``start`` (target, source, rank,
    weight). Every round bounds all moves of a weight between two sources of all targets in
    one pass (targets x sources^2 candidates), takes the exact AUC of those that can be the
    best of their target, and the best one if it raises AUC - alpha * sum((w - 1/n)^2); a target
    repeats a move's round as long as it improves. Never below the start. One-source and constant
    targets keep their weights (objective null)."""
    spark = start.sparkSession
    flat = labels.groupBy("target").agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a = b")
    fixed = {r["target"] for r in flat.select("target").collect()}
    table: dict = {}
    for r in start.orderBy("target", "rank").collect():            # targets x sources
        table.setdefault(r["target"], []).append((r["source"], r["weight"]))
    now = {t: bounded_projection([w for _, w in v], min_w, max_w) for t, v in table.items()
           if len(v) > 1 and t not in fixed}
    sources = {t: [s for s, _ in v] for t, v in table.items()}
    ranks = [(t, s, i) for t, v in sources.items() if t in now for i, s in enumerate(v)]
    value: dict = {}
    if now:
        width = max(len(w) for w in now.values())
        order = spark.createDataFrame(ranks, "target string, source string, i int")
        wide = (oof.join(F.broadcast(order), ["target", "source"])          # bounded
                   .groupBy("target", "customer_id").agg(*[
                       F.max(F.when(F.col("i") == i, F.col("score"))).alias(f"r_{i}")
                       for i in range(width)]).join(labels, ["target", "customer_id"]))
        rows = Blends(wide, now, [f"r_{i}" for i in range(width)])

        def penalty(w) -> float:
            return alpha * float(((w - 1 / len(w)) ** 2).sum())

        def objectives(points: list, floor: dict | None = None) -> dict:
            own: dict = {}
            for t, c, w in points:
                own.setdefault(t, []).append((c, w))
            pens = {(t, c): penalty(w) for t, c, w in points}
            if floor:
                own = rows.contenders(own, GRID_ROUNDS[-1], lambda t, c: pens[t, c], floor)
            got = rows.aucs(own).collect() if own else []
            return {(r["target"], r["point"]): round(r["auc"] - pens[r["target"], r["point"]],
                                                     AUC_DIGITS) for r in got}

        value = {t: v for (t, _), v in objectives([(t, 0, w) for t, w in now.items()]).items()}
        for move in moves:
            open_ = set(now)
            while open_:
                points = []
                for t in sorted(open_):
                    pairs = [(i, j) for i in range(len(now[t])) for j in range(len(now[t])) if i != j]
                    for c, (i, j) in enumerate(pairs):
                        w = now[t].copy()
                        w[i] += move
                        w[j] -= move
                        points.append((t, c, bounded_projection(w, min_w, max_w)))
                made = {(t, c): w for t, c, w in points}
                best: dict = {}
                for (t, c), v in sorted(objectives(points, value).items()):
                    if v > best.get(t, (value[t],))[0]:
                        best[t] = (v, c)
                for t, (v, c) in best.items():
                    now[t], value[t] = made[(t, c)], v
                open_ = set(best)
    out = [(t, s, i + 1, float(now[t][i]) if t in now else float(table[t][i][1]), value.get(t))
           for t, v in sources.items() for i, s in enumerate(v)]
    return spark.createDataFrame(out, "target string, source string, rank int, weight double, "
                                      "objective double")


def apply_weights(preds: DataFrame, weights: DataFrame) -> DataFrame:
    """(split, target, customer_id, score): w_1*s_1 + w_2*s_2 + ... in rank order.

    The weights table is broadcast (at most targets x sources rows). The terms of a row
    are added in rank order, whatever their number, so the result is the same double
    whatever the row order (no rounding needed downstream). There is a plain sum per rank:
    lists of the terms would be gathered by sorting all predictions. A prediction with a target
    that has no weight is an error of the routing, not a null: ``require_covered``.
    """
    j = preds.join(F.broadcast(weights.select("target", "source", "rank", "weight")),
                   ["target", "source"])
    ranks = sorted(r["rank"] for r in weights.select("rank").distinct().collect())   # bounded
    term = F.col("weight") * F.col("score")
    sums = [F.coalesce(F.sum(F.when(F.col("rank") == k, term)), F.lit(0.0)) for k in ranks]
    return j.groupBy("split", "target", "customer_id").agg(
        sum(sums, F.lit(0.0)).alias("score"))


def require_covered(labels: DataFrame, preds: DataFrame) -> DataFrame:
    """(target, n_sources); raises for targets that no source covers."""
    cov = (labels.select("target").distinct()
           .join(preds.filter("split = 'oof'").select("target", "source").distinct(),
                 "target", "left")
           .groupBy("target").agg(F.count("source").cast("bigint").alias("n_sources")))
    bare = [r["target"] for r in cov.where("n_sources = 0").collect()]   # bounded by targets
    if bare:
        raise ValueError(f"targets without a source: {sorted(bare)}")
    return cov


def final_aucs(routed: DataFrame, labels: DataFrame) -> DataFrame:
    scored = routed.filter("split = 'oof'").join(labels, ["target", "customer_id"])
    return exact_auc(scored, ["target"], score_digits=None).select(
        "target", F.col("auc").alias("final_auc"))


def source_usage(manifest: DataFrame, pools: DataFrame, weights: DataFrame) -> DataFrame:
    """Per source — targets selected, weight sum, max weight, pool count and the
    average weight when selected (weight sum / max(selected, 1))."""
    sel = weights.groupBy("source").agg(F.count(F.lit(1)).alias("targets_selected_count"),
                                        F.sum("weight").alias("weight_sum"),
                                        F.max("weight").alias("max_weight_seen"))
    pc = pools.groupBy("source").agg(F.count(F.lit(1)).alias("candidate_pool_count"))
    j = manifest.join(sel, "source", "left").join(pc, "source", "left")
    n = F.coalesce(F.col("targets_selected_count"), F.lit(0))
    ws = F.coalesce(F.col("weight_sum"), F.lit(0.0))
    return j.select("source", n.cast("bigint").alias("targets_selected_count"),
                    F.round(ws, 9).alias("weight_sum"),
                    F.round(F.coalesce(F.col("max_weight_seen"), F.lit(0.0)), 9).alias("max_weight_seen"),
                    F.coalesce(F.col("candidate_pool_count"), F.lit(0)).cast("bigint")
                    .alias("candidate_pool_count"),
                    F.round(ws / F.greatest(n, F.lit(1)), 9).alias("avg_weight_when_selected"))


def source_fingerprints(preds: DataFrame) -> DataFrame:
    """L12 (re-aimed): order-free content fingerprint per source:
    (source, n_rows, fp): sums of two independent 64-bit hashes of (split, target, id,
    score) as decimals (no overflow) and their xor."""
    scaled = F.round(F.col("score") * 1e9).cast("bigint")
    keys = ["split", "target", "customer_id", scaled]
    one, two = F.xxhash64(F.lit(1), *keys), F.xxhash64(F.lit(2), *keys)
    return preds.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.struct(F.sum(one.cast("decimal(20,0)")).alias("a"),
                 F.sum(two.cast("decimal(20,0)")).alias("b"),
                 F.bit_xor(one).alias("x")).alias("fp"))


def duplicate_sources(preds: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source, duplicate_of): sources whose fingerprint equals an earlier source's."""
    fp = source_fingerprints(preds).join(F.broadcast(manifest), "source")
    w = Window.partitionBy("n_rows", "fp")
    return (fp.withColumn("_first", F.min(F.struct("position", "source")).over(w))
              .withColumn("_cnt", F.count(F.lit(1)).over(w))
              .filter(F.col("_cnt") > 1)
              .select("source", F.col("_first.source").alias("duplicate_of")))


def id_alignment(preds: DataFrame, mart: DataFrame) -> DataFrame:
    """B2: per (source, split) ids present, ids missing from the source and ids the
    source has that the split does not (sets, not row order)."""
    ids = mart.select("customer_id", F.when(F.col("is_test") == 1, F.lit("test"))
                      .otherwise(F.lit("oof")).alias("_own"))
    have = preds.select("source", "split", "customer_id").distinct().join(ids, "customer_id",
                                                                          "left")
    inside = F.col("_own").eqNullSafe(F.col("split"))
    got = have.groupBy("source", "split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_ids"),
        F.sum(inside.cast("bigint")).alias("_in"))
    size = ids.groupBy(F.col("_own").alias("split")).agg(F.count(F.lit(1)).alias("_all"))
    return got.join(F.broadcast(size), "split", "left").select(   # two rows
        "source", "split", "n_ids",
        (F.coalesce("_all", F.lit(0)) - F.col("_in")).cast("bigint").alias("n_missing"),
        (F.col("n_ids") - F.col("_in")).cast("bigint").alias("n_extra"))
