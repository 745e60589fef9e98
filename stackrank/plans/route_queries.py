"""Routing queries: per-target source order, pools, modes, usage, submission."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackrank.operators import route as R
from stackrank.plans.catalog import query
from stackrank.plans.sqlblocks import block, with_ctes
from stackrank.sources import mart as MT
from stackrank.sources import predictions as P
from stackrank.sources.context import context, cut, materialize, stored

# Parameters of the routing queries.
POOL_DELTA, POOL_CAP = 0.02, 2
OPT_WIDTH, OPT_UNITS = len(P.SOURCE_ORDER), 10      # all sources, weights in tenths
PRIMARY, FALLBACK = "s_spec", "s_bal"

block("const", ("labels",),
      "SELECT target, min(y) = max(y) AS is_constant FROM labels GROUP BY target")
block("ordered", ("src_auc", "manifest", "const"), """SELECT a.target, a.source, m.position, a.auc,
  c.is_constant, row_number() OVER (PARTITION BY a.target ORDER BY
    CASE WHEN c.is_constant THEN NULL ELSE a.auc END DESC NULLS LAST, m.position)::INTEGER AS ord
FROM src_auc a JOIN manifest m USING (source) JOIN const c USING (target)""")
block("wtable", (), """SELECT width, rank, round(w / sum(w) OVER (PARTITION BY width), 12) AS weight
FROM (VALUES (1, 1, 1.0::DOUBLE), (2, 1, 0.65::DOUBLE), (2, 2, 0.35::DOUBLE),
             (3, 1, 0.45::DOUBLE), (3, 2, 0.35::DOUBLE), (3, 3, 0.2::DOUBLE)) t(width, rank, w)""")


def _pool_sql(width: int, delta: float, cap: int) -> str:
    keep = "TRUE"
    if delta > 0:
        keep = (f"CASE WHEN sum(keep0::INTEGER) OVER (PARTITION BY target) < least({width}, n) "
                f"THEN ord <= least({width}, n) ELSE keep0 END")
    inner = f"""SELECT *, {keep} AS keep FROM (
  SELECT *, count(*) OVER (PARTITION BY target) AS n,
    is_constant OR ord = 1 OR (max(CASE WHEN ord = 1 THEN auc END) OVER (PARTITION BY target) - auc)
      <= {delta} AS keep0
  FROM ordered)"""
    capped = f"""SELECT target, source, position, auc, is_constant, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord) AS prank,
         count(*) OVER (PARTITION BY target) AS pn
  FROM ({inner}) WHERE keep)"""
    if cap > 0:
        capped += f" WHERE prank <= greatest({cap}, least({width}, pn))"
    return capped


def _fixed_ctes(width: int, delta: float = 0.0, cap: int = 0) -> list[tuple[str, str]]:
    return [
        ("pool", _pool_sql(width, delta, cap)),
        ("top", f"SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord)::INTEGER AS rank "
                f"FROM pool QUALIFY rank <= {width}"),
        ("wts", "SELECT t.target, t.source, t.rank, w.weight FROM top t JOIN (SELECT target, "
                "count(*) AS width FROM top GROUP BY target) n USING (target) JOIN wtable w "
                "ON w.width = n.width AND w.rank = t.rank"),
    ] + _final_ctes()


def _final_ctes() -> list[tuple[str, str]]:
    return [
        ("routed", "SELECT p.split, p.target, p.customer_id, " + " + ".join(
            f"coalesce(max(CASE WHEN w.rank = {i} THEN w.weight * p.score END), 0.0)"
            for i in range(1, OPT_WIDTH + 1)) + " AS score "
                   "FROM preds p JOIN wts w USING (target, source) GROUP BY ALL"),
        ("rscored", "SELECT r.target, r.score, l.y FROM routed r JOIN labels l "
                    "USING (target, customer_id) WHERE r.split = 'oof'"),
        ("fauc", "SELECT target, auc AS final_auc FROM " + _auc("rscored", "target", digits=None)),
    ]


def _auc(rel, g, digits=9):
    from stackrank.plans.sqlblocks import auc_sql
    return auc_sql(rel, g, digits=digits)


def _routing(ctx, mode, delta=0.0, cap=0):
    spark = ctx.spark
    ordered = cut(R.source_aucs(ctx.source_auc(), ctx.labels, P.manifest_frame(spark)))
    pool = cut(R.candidate_pool(ordered, mode, delta, cap))
    return ordered, pool


def _fixed(spark, sf_dir, mode, delta=0.0, cap=0):
    ctx = context(spark, sf_dir)
    _, pool = _routing(ctx, mode, delta, cap)
    w = cut(R.fixed_mode_weights(spark, pool, mode))
    fa = R.final_aucs(R.apply_weights(ctx.preds, w), ctx.labels)
    return w.join(fa, "target", "left")


_deps = ("ordered", "wtable", "preds", "labels")


@query("route_winner", with_ctes(
    "SELECT w.target, w.source, w.rank, w.weight, f.final_auc FROM wts w LEFT JOIN fauc f USING (target)",
    *_deps, extra=_fixed_ctes(1)))
def q_route_winner(spark, sf_dir):
    """L4 + I6 + L15: the best source per target (manifest order on ties and for
    constant targets), its weight and the routed OOF AUC."""
    return _fixed(spark, sf_dir, "winner")


@query("route_top2", with_ctes(
    "SELECT w.target, w.source, w.rank, w.weight, f.final_auc FROM wts w LEFT JOIN fauc f USING (target)",
    *_deps, extra=_fixed_ctes(2)))
def q_route_top2(spark, sf_dir):
    """L5 + C11: top-2 at .65/.35 (normalised); one available source -> weight 1."""
    return _fixed(spark, sf_dir, "top2_weighted")


@query("route_top3", with_ctes(
    "SELECT w.target, w.source, w.rank, w.weight, f.final_auc FROM wts w LEFT JOIN fauc f USING (target)",
    *_deps, extra=_fixed_ctes(3)))
def q_route_top3(spark, sf_dir):
    """Top-3 at .45/.35/.20; two sources -> the top-2 weights; one -> 1."""
    return _fixed(spark, sf_dir, "top3_weighted")


def _top2_routed(ctx):
    """Routed predictions (both splits) of the top-2 mode."""
    _, pool = _routing(ctx, "top2_weighted")
    w = cut(R.fixed_mode_weights(ctx.spark, pool, "top2_weighted"))
    return R.apply_weights(ctx.preds, w)


@query("route_apply", with_ctes("SELECT split, target, customer_id, score FROM routed", *_deps,
                                extra=_fixed_ctes(2)))
def q_route_apply(spark, sf_dir):
    """The routed out-of-fold and test scores themselves."""
    return _top2_routed(context(spark, sf_dir))


@query("route_macro", with_ctes(
    "SELECT count(final_auc)::BIGINT AS n_scored, round(avg(final_auc), 14) AS macro_auc FROM fauc",
    *_deps, extra=_fixed_ctes(2)))
def q_route_macro(spark, sf_dir):
    """Macro AUC of the routed out-of-fold scores (constant targets are left out)."""
    ctx = context(spark, sf_dir)
    fa = R.final_aucs(_top2_routed(ctx), ctx.labels)
    return fa.agg(F.count("final_auc").cast("bigint").alias("n_scored"),
                  F.round(F.avg("final_auc"), 14).alias("macro_auc"))


@query("route_pool", with_ctes(
    "SELECT target, source, ord, auc FROM pool", "ordered",
    extra=[("pool", _pool_sql(2, POOL_DELTA, POOL_CAP))]))
def q_route_pool(spark, sf_dir):
    """L7 + L8: gap-to-best filter (delta .02, at least the mode's width) and cap 2."""
    ctx = context(spark, sf_dir)
    _, pool = _routing(ctx, "top2_weighted", POOL_DELTA, POOL_CAP)
    return pool.select("target", "source", "ord", "auc")


def _opt_sql() -> str:
    from stackrank.plans.core_queries import _grid_sql
    grids = []
    for n in range(1, OPT_WIDTH + 1):
        gs = _grid_sql(n, OPT_UNITS) if n > 1 else \
            f"SELECT 1 AS grid_id, {OPT_UNITS} AS u_0, 1.0::DOUBLE AS w_0"
        ok = " AND ".join(f"w_{i} >= 0.01 - 1e-12 AND w_{i} <= 0.99 + 1e-12" for i in range(n)) \
            if n > 1 else "TRUE"
        pen = " + ".join(["0.0::DOUBLE"] + [f"pow(w_{i} - 1.0::DOUBLE / {n}, 2)" for i in range(n)])
        cols = ", ".join((f"w_{i}" if i < n else "0.0::DOUBLE") + f" AS g_{i + 1}" for i in range(OPT_WIDTH))
        grids.append(f"SELECT {n} AS width, grid_id, {cols}, {pen} AS pen FROM ({gs}) WHERE {ok}")
    grid = "\nUNION ALL\n".join(grids)
    piv = ", ".join(f"max(CASE WHEN rank = {i} THEN score END) AS r_{i}" for i in range(1, OPT_WIDTH + 1))
    blend = " + ".join(["g.g_1 * x.r_1"] + [f"g.g_{i} * coalesce(x.r_{i}, 0.0)"
                                             for i in range(2, OPT_WIDTH + 1)])
    ctes = [
        ("pool", _pool_sql(1, 0.0, 0)),
        ("rk", f"SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord)::INTEGER AS rank "
               f"FROM pool QUALIFY rank <= {OPT_WIDTH}"),
        ("widths", "SELECT target, count(*)::INTEGER AS width, first(is_constant) AS is_constant "
                   "FROM rk GROUP BY target"),
        ("grid", grid),
        ("wide", f"""SELECT x.target, x.customer_id, l.y, w.width, {', '.join(f'x.r_{i}' for i in range(1, OPT_WIDTH + 1))}
FROM (SELECT p.target, p.customer_id, {piv} FROM preds p JOIN rk USING (target, source)
      WHERE p.split = 'oof' GROUP BY p.target, p.customer_id) x
JOIN labels l USING (target, customer_id) JOIN widths w USING (target) WHERE NOT w.is_constant"""),
        ("gscored", f"SELECT x.target, g.grid_id, x.y, {blend} AS score FROM wide x JOIN grid g USING (width)"),
        ("gauc", "SELECT * FROM " + _auc("gscored", "target, grid_id", digits=None)),
        ("best", """SELECT a.target, w.width, a.grid_id FROM gauc a JOIN widths w USING (target)
JOIN grid g ON g.width = w.width AND g.grid_id = a.grid_id
QUALIFY row_number() OVER (PARTITION BY a.target ORDER BY round(a.auc - 0.1 * g.pen, 12) DESC NULLS LAST,
  a.grid_id) = 1"""),
        ("wts", f"""SELECT r.target, r.source, r.rank, [{', '.join(f'g.g_{i}' for i in range(1, OPT_WIDTH + 1))}][r.rank] AS weight
FROM rk r JOIN best b USING (target) JOIN grid g ON g.width = b.width AND g.grid_id = b.grid_id
UNION ALL
SELECT r.target, r.source, r.rank, 1.0::DOUBLE / w.width AS weight FROM rk r JOIN widths w USING (target)
WHERE w.is_constant"""),
    ] + _final_ctes()
    return with_ctes("SELECT w.target, w.source, w.rank, w.weight, f.final_auc FROM wts w "
                     "LEFT JOIN fauc f USING (target)", *_deps, extra=ctes)


@query("route_optimized", _opt_sql())
def q_route_optimized(spark, sf_dir):
    """L9 (re-aimed): regularised bounded grid search over all rows and all sources."""
    ctx = context(spark, sf_dir)
    w = _optimized(ctx)
    fa = R.final_aucs(R.apply_weights(ctx.preds, w), ctx.labels)
    return w.join(fa, "target", "left")


def _optimized(ctx):
    _, pool = _routing(ctx, "optimize_weights")
    oof = ctx.preds.filter("split = 'oof'")
    return materialize(ctx.spark, (*ctx._key, "route_optimized"), lambda: R.optimized_weights(
        ctx.spark, pool, oof, ctx.labels, step=1.0 / OPT_UNITS))


@query("route_continuous")
def q_route_continuous(spark, sf_dir):
    """L9 + L10: continuous weights: from the grid's best point on, moves of weight between two
    sources, projected onto the bounds, as long as the objective rises."""
    ctx = context(spark, sf_dir)
    oof = ctx.preds.filter("split = 'oof'")
    w = cut(R.refined_weights(_optimized(ctx), oof, ctx.labels))
    fa = R.final_aucs(R.apply_weights(ctx.preds, w), ctx.labels)
    return w.join(fa, "target", "left")


@query("source_coverage", with_ctes(
    "SELECT t.target, count(DISTINCT p.source)::BIGINT AS n_sources FROM "
    "(SELECT DISTINCT target FROM labels) t LEFT JOIN preds p ON p.target = t.target AND p.split = 'oof' "
    "GROUP BY t.target", "labels", "preds"))
def q_source_coverage(spark, sf_dir):
    """Sources covering each target (a target with none is an error)."""
    ctx = context(spark, sf_dir)
    return R.require_covered(ctx.labels, ctx.preds)


@query("source_duplicates", with_ctes("""SELECT source, first_source AS duplicate_of FROM (
  SELECT f.source, count(*) OVER w AS cnt,
    arg_min(f.source, m.position) OVER w AS first_source
  FROM (SELECT source, count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws(':', 'fp', split, target,
          CAST(customer_id AS VARCHAR), CAST(CAST(round(score * 1e9) AS BIGINT) AS VARCHAR))), 1, 8))::BIGINT)
          AS fp FROM preds GROUP BY source) f JOIN manifest m USING (source)
  WINDOW w AS (PARTITION BY f.n_rows, f.fp)) WHERE cnt > 1""", "preds", "manifest"))
def q_source_duplicates(spark, sf_dir):
    """Content-identical sources (s_dup copies s_bal)."""
    ctx = context(spark, sf_dir)
    return R.duplicate_sources(ctx.preds, P.manifest_frame(spark))


_top2_deps = _fixed_ctes(2)


@query("source_usage", with_ctes("""SELECT m.source,
  coalesce(s.n, 0)::BIGINT AS targets_selected_count, round(coalesce(s.ws, 0), 9) AS weight_sum,
  round(coalesce(s.mx, 0), 9) AS max_weight_seen, coalesce(c.pc, 0)::BIGINT AS candidate_pool_count,
  round(coalesce(s.ws, 0) / greatest(coalesce(s.n, 0), 1), 9) AS avg_weight_when_selected
FROM manifest m
LEFT JOIN (SELECT source, count(*) AS n, sum(weight) AS ws, max(weight) AS mx FROM wts GROUP BY source) s
  USING (source)
LEFT JOIN (SELECT source, count(*) AS pc FROM pool GROUP BY source) c USING (source)""",
    *_deps, "manifest", extra=_top2_deps))
def q_source_usage(spark, sf_dir):
    """L13 for the top-2 routing."""
    ctx = context(spark, sf_dir)
    _, pool = _routing(ctx, "top2_weighted")
    w = R.fixed_mode_weights(spark, pool, "top2_weighted")
    return R.source_usage(P.manifest_frame(spark), pool, w)


@query("route_report", with_ctes("""SELECT o.target, o.source, o.auc,
  (p.source IS NOT NULL)::INTEGER AS in_pool, coalesce(w.weight, 0.0) AS weight, f.final_auc
FROM ordered o LEFT JOIN pool p USING (target, source) LEFT JOIN wts w USING (target, source)
LEFT JOIN fauc f USING (target)""", *_deps, extra=_fixed_ctes(2, POOL_DELTA, 0)))
def q_route_report(spark, sf_dir):
    """Per (target, source) AUC, pool membership, chosen weight, final AUC."""
    ctx = context(spark, sf_dir)
    ordered, pool = _routing(ctx, "top2_weighted", POOL_DELTA, 0)
    w = R.fixed_mode_weights(spark, pool, "top2_weighted")
    fa = R.final_aucs(R.apply_weights(ctx.preds, w), ctx.labels)
    return (ordered.select("target", "source", "auc")
            .join(pool.select("target", "source", F.lit(1).alias("in_pool")),
                  ["target", "source"], "left")
            .join(w.select("target", "source", "weight"), ["target", "source"], "left")
            .join(fa, "target", "left")
            .select("target", "source", "auc",
                    F.coalesce("in_pool", F.lit(0)).cast("int").alias("in_pool"),
                    F.coalesce("weight", F.lit(0.0)).alias("weight"), "final_auc"))


@query("fill_failed", with_ctes(
    f"SELECT i.customer_id, t.target, coalesce(p.score, 0.0) AS score FROM "
    f"(SELECT customer_id FROM mart WHERE is_test = 1) i CROSS JOIN (SELECT DISTINCT target FROM labels) t "
    f"LEFT JOIN preds p ON p.customer_id = i.customer_id AND p.target = t.target "
    f"AND p.source = '{PRIMARY}' AND p.split = 'test'", "mart", "labels", "preds"))
def q_fill_failed(spark, sf_dir):
    """A partial source's test predictions on the full (id, target) grid;
    targets it failed (does not cover) score 0."""
    ctx = context(spark, sf_dir)
    ids = ctx.mart.filter("is_test = 1").select("customer_id")
    targets = ctx.labels.select("target").distinct()
    src = ctx.preds.filter((F.col("source") == PRIMARY) & (F.col("split") == "test"))
    return (ids.crossJoin(F.broadcast(targets))   # one row per target: bounded
               .join(src.select("customer_id", "target", "score"), ["customer_id", "target"], "left")
               .select("customer_id", "target", F.coalesce("score", F.lit(0.0)).alias("score")))


_sub_cols = [t.replace("target_", "predict_", 1) for t in MT.TARGETS]


@query("submission", with_ctes(
    "SELECT s.customer_id, " + ", ".join(
        f"max(CASE WHEN x.target = '{t}' THEN x.score END)::DOUBLE AS {c}"
        for t, c in zip(MT.TARGETS, _sub_cols))
    + f" FROM (SELECT customer_id FROM mart WHERE is_test = 1) s LEFT JOIN ("
      f"SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, coalesce(a.target, b.target) AS target, "
      f"coalesce(a.score, b.score) AS score FROM (SELECT * FROM preds WHERE split = 'test' AND source = '{PRIMARY}') a "
      f"FULL JOIN (SELECT * FROM preds WHERE split = 'test' AND source = '{FALLBACK}') b "
      f"ON a.customer_id = b.customer_id AND a.target = b.target) x USING (customer_id) GROUP BY s.customer_id",
    "mart", "preds"))
def q_submission(spark, sf_dir):
    """The sample's id set and column order; each target from the primary
    source, else the fallback; cast to the sample's type (DOUBLE)."""
    ctx = context(spark, sf_dir)
    test = ctx.preds.filter("split = 'test'")
    a = test.filter(F.col("source") == PRIMARY).select("customer_id", "target", F.col("score").alias("a"))
    b = test.filter(F.col("source") == FALLBACK).select("customer_id", "target", F.col("score").alias("b"))
    x = a.join(b, ["customer_id", "target"], "full").select(
        "customer_id", "target", F.coalesce("a", "b").alias("score"))
    sample = ctx.mart.filter("is_test = 1").select("customer_id")
    wide = x.groupBy("customer_id").agg(*[
        F.max(F.when(F.col("target") == t, F.col("score"))).cast("double").alias(c)
        for t, c in zip(MT.TARGETS, _sub_cols)])
    return assemble_submission(sample, wide, _sub_cols)


@query("submission_routed", with_ctes(
    "SELECT s.customer_id, " + ", ".join(
        f"max(CASE WHEN r.target = '{t}' THEN r.score END)::DOUBLE AS {c}"
        for t, c in zip(MT.TARGETS, _sub_cols))
    + " FROM (SELECT customer_id FROM mart WHERE is_test = 1) s LEFT JOIN (SELECT * FROM routed "
      "WHERE split = 'test') r USING (customer_id) GROUP BY s.customer_id",
    *_deps, "mart", extra=_fixed_ctes(2)))
def q_submission_routed(spark, sf_dir):
    """A13 + L14: the submission of the routed test scores."""
    ctx = context(spark, sf_dir)
    wide = _top2_routed(ctx).filter("split = 'test'").groupBy("customer_id").agg(*[
        F.max(F.when(F.col("target") == t, F.col("score"))).cast("double").alias(c)
        for t, c in zip(MT.TARGETS, _sub_cols)])
    return assemble_submission(ctx.mart.filter("is_test = 1").select("customer_id"), wide,
                               _sub_cols)


def assemble_submission(sample, wide, columns):
    """One row per sample id with every column filled. Raises on a missing column, ids
    outside the sample (Q2), ids without a prediction, and empty cells."""
    lacking = [c for c in columns if c not in wide.columns]
    if lacking:
        raise ValueError(f"columns without predictions: {lacking}")
    both = stored(sample.withColumn("_s", F.lit(1)).join(wide.withColumn("_w", F.lit(1)),
                                                         "customer_id", "full"))
    bad = both.agg(F.count(F.when(F.col("_s").isNull(), 1)).alias("extra"),
                   F.count(F.when(F.col("_w").isNull(), 1)).alias("missing"),
                   *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first()
    if any(bad):
        raise ValueError(f"submission does not fit the sample: {bad.asDict()}")
    return both.select("customer_id", *columns)


@query("id_alignment", with_ctes("""SELECT s.source, s.split, s.n_ids::BIGINT AS n_ids,
  coalesce(mi.n_missing, 0)::BIGINT AS n_missing, coalesce(ex.n_extra, 0)::BIGINT AS n_extra
FROM (SELECT source, split, count(DISTINCT customer_id) AS n_ids FROM preds GROUP BY ALL) s
LEFT JOIN (SELECT p.source, p.split, count(*) AS n_missing FROM
    (SELECT DISTINCT source, split FROM preds) p JOIN ids i USING (split)
    WHERE NOT EXISTS (SELECT 1 FROM preds q WHERE q.source = p.source AND q.split = p.split
                      AND q.customer_id = i.customer_id) GROUP BY ALL) mi USING (source, split)
LEFT JOIN (SELECT source, split, count(*) AS n_extra FROM (SELECT DISTINCT source, split, customer_id
    FROM preds) q WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.split = q.split
    AND i.customer_id = q.customer_id) GROUP BY ALL) ex USING (source, split)""",
    "preds", "mart", extra=[("ids", "SELECT customer_id, CASE WHEN is_test = 1 THEN 'test' ELSE 'oof' END "
                                    "AS split FROM mart")]))
def q_id_alignment(spark, sf_dir):
    """B2: id sets per source and split against the mart (order is meaningless)."""
    ctx = context(spark, sf_dir)
    return R.id_alignment(ctx.preds, ctx.mart)


@query("pending_targets", with_ctes(
    "SELECT t.target, m.source FROM (SELECT DISTINCT target FROM labels) t CROSS JOIN manifest m "
    "WHERE NOT EXISTS (SELECT 1 FROM preds p WHERE p.target = t.target AND p.source = m.source)",
    "labels", "manifest", "preds"))
def q_pending_targets(spark, sf_dir):
    """The (target, source) work list minus outputs that already exist."""
    ctx = context(spark, sf_dir)
    work = ctx.labels.select("target").distinct().crossJoin(F.broadcast(P.manifest_frame(spark)))
    done = ctx.preds.select("target", "source").distinct()
    return work.join(done, ["target", "source"], "left_anti").select("target", "source")


@query("stream_source_scores", with_ctes(
    "SELECT target, source, n_pos, n_neg, auc FROM src_auc", "src_auc"))
def q_stream_source_scores(spark, sf_dir):
    """A9 + A14 in streaming form: sources are written to the prediction sink in two
    waves; a file-source stream scores each wave as it lands (availableNow trigger);
    the score table then holds every (target, source) AUC."""
    import os
    from stackrank.sources import reports as RS
    from stackrank.streaming import read_scores, start_scoring
    ctx = context(spark, sf_dir)
    base = RS.scratch_path(spark, "stream")
    pred_dir, score_dir = os.path.join(base, "preds"), os.path.join(base, "scores")
    ckpt = os.path.join(base, "checkpoint")
    first, second = list(P.SOURCE_ORDER[:2]), list(P.SOURCE_ORDER[2:])
    for wave in (first, second):
        part = ctx.preds.filter(F.col("source").isin(wave))
        with P.open_writers(spark, len(wave)):
            part.write.mode("append").partitionBy("source").parquet(pred_dir)
        q = start_scoring(spark, pred_dir, ctx.labels, score_dir, ckpt)
        q.awaitTermination()
    return read_scores(spark, score_dir)
