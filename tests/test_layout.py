"""The shared inputs' layout: joins on the customer neither shuffle nor broadcast."""

from pyspark.sql import functions as F

from stackrank.operators import metrics as M
from stackrank.operators import route as R
from stackrank.sources import predictions as P


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_are_never_broadcast(ctx):
    routed = ctx.preds.groupBy("split", "target", "customer_id").agg(F.max("score").alias("score"))
    plan = _plan(routed.filter("split = 'oof'").join(ctx.labels, ["target", "customer_id"]))
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan                    # neither a shuffle nor a broadcast


def test_routed_scores_are_not_shuffled(ctx):
    w = ctx.spark.createDataFrame([("target_1_1", "s_bal", 1, 0.65), ("target_1_1", "s_te_seg", 2, 0.35)],
                                  "target STRING, source STRING, rank INT, weight DOUBLE")
    plan = _plan(R.apply_weights(ctx.preds, w))
    assert "Exchange hashpartitioning" not in plan


def test_counts_are_those_of_the_long_rows(ctx):
    def rows(df):
        return sorted(map(tuple, df.select("target", "source", "fold", "_s", "p", "n").collect()))
    by_row = M.collapse_scores(ctx.oof_scored().join(ctx.folds, "customer_id"),
                               ["target", "source", "fold"])
    packed = P.score_counts(ctx._oof().join(ctx.folds, "customer_id"), ["fold"])
    assert rows(by_row) == rows(packed)


def test_repeated_and_null_customers_multiply_as_in_the_joins(spark):
    extra = [None] * 21
    extra[4] = 5.0
    rows = [(1, 0, 10.0, 3.0, "1-URGENT", "F", "A", 1, extra), (1, 0, 10.0, 5.0, "2-HIGH", "F", "B", 1, extra),
            (2, 0, 20.0, 7.0, "2-HIGH", "F", None, 2, extra), (None, 0, 20.0, 7.0, "2-HIGH", "F", "A", 2, extra),
            (3, 1, 20.0, 9.0, "2-HIGH", "F", "A", 2, extra)]
    from stackrank.sources.mart import labels_array
    mart = spark.createDataFrame(rows, "customer_id BIGINT, is_test INT, num_feature_totalprice DOUBLE, "
                                 "num_feature_acctbal DOUBLE, cat_feature_priority STRING, "
                                 "cat_feature_status STRING, cat_feature_segment STRING, "
                                 "cat_feature_nation INT, extra ARRAY<DOUBLE>")
    folds = spark.createDataFrame([(1, 0), (2, 1)], "customer_id BIGINT, fold INT")
    got = {(r["split"], r["source"], r["customer_id"]): r["count"] for r in P.long_sources(
        P.build_scores(mart, labels_array(mart), folds)).groupBy(
        "split", "source", "customer_id").count().collect()}
    assert got[("oof", "s_te_seg", 1)] == 4 * 7 and got[("oof", "s_bal", 1)] == 2 * 7
    assert ("oof", "s_te_seg", None) not in got and got[("oof", "s_spec", None)] == 2
    assert got[("test", "s_te_nation", 3)] == 7 and got[("oof", "s_te_seg", 2)] == 7


def _grid_rows(spark, ys):
    """Scores of three points for rows with labels ``ys``: the last point ranks best."""
    rows = [("t", g, float((i * (7, 5, 1)[g]) % len(ys)), y) for i, y in enumerate(ys)
            for g in range(3)]
    return spark.createDataFrame(rows, "target STRING, grid_id INT, score DOUBLE, y INT").withColumns(
        {"_min": F.lit(0.0), "_max": F.lit(float(len(ys)))})


def test_finer_bins_leave_fewer_points_and_keep_the_best(spark):
    df = _grid_rows(spark, [0] * 40 + [1] * 24)
    best = M.exact_auc(df, ["target", "grid_id"]).orderBy(F.desc("auc")).first()["grid_id"]
    left = [{r["grid_id"] for r in M.grid_contenders(df, ["target"], "grid_id", "_min", "_max",
                                                     bins=n).collect()} for n in (1, 4096)]
    assert left[0] == {0, 1, 2} and left[1] == {best}


def test_missing_labels_never_drop_the_best_point(spark):
    for k in range(2, 6):
        df = _grid_rows(spark, [None if i % k == 0 else int(i % 7 in (1, 2)) for i in range(64)])
        aucs = {r["grid_id"]: r["auc"] for r in M.exact_auc(df, ["target", "grid_id"]).collect()}
        left = {r["grid_id"] for r in M.grid_contenders(df, ["target"], "grid_id", "_min", "_max",
                                                        bins=4096).collect()}
        assert max(aucs, key=aucs.get) in left


def test_products_are_those_of_the_long_rows(spark):
    rows = [(1, "oof", True, [float(i) for i in range(7)], [2.0] * 7, None, None),
            (1, "oof", False, None, None, 3.0, 5.0), (1, "oof", False, None, None, 4.0, None),
            (2, "test", True, [1.5] * 7, [0.5] * 7, None, None),
            (None, "test", True, [2.5] * 7, [1.0] * 7, None, None),
            (None, "test", False, None, None, 7.0, 2.0), (3, "oof", False, None, None, 1.0, 1.0)]
    scores = spark.createDataFrame(rows, "customer_id BIGINT, split STRING, encoded BOOLEAN, "
                                   "s_te_seg ARRAY<DOUBLE>, s_te_nation ARRAY<DOUBLE>, bal DOUBLE, "
                                   "spec DOUBLE")
    long = [tuple(r) for r in P.long_sources(scores).select(
        "split", "customer_id", "target", "source", "score").collect()]
    want = sorted([(a[0], a[1], a[2], a[3], b[3], None if None in (a[4], b[4]) else a[4] * b[4])
                   for a in long for b in long if a[:3] == b[:3] and a[3] < b[3]], key=str)
    got = sorted(map(tuple, P.source_products(scores, P.SOURCE_ORDER).collect()), key=str)
    assert got == want


def test_products_and_shuffles_move_rows_per_customer(ctx):
    from stackrank.plans import feature_queries as FQ

    plan = _plan(P.source_products(ctx.scores, P.SOURCE_ORDER).where("customer_id IS NOT NULL"))
    assert "hashpartitioning(customer_id" not in plan and "Aggregate" not in plan
    plan = FQ.q_shuffle_column(ctx.spark, ctx.sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Window")
