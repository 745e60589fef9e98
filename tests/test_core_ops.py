"""Literal edge cases (FIXTURES section 3) and split-path equivalence."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stackrank.functions.hashing import h

from stackrank.operators import blend as B
from stackrank.operators import metrics as M
from stackrank.operators import route as R
from stackrank.operators.positions import hash_positions
from stackrank.operators import rank as RK
from stackrank.operators.rank import rank_average, rank_normalize
from stackrank.plans.route_queries import assemble_submission


def _scored(spark, scores, labels, group="g"):
    return spark.createDataFrame(
        [(group, i + 1, float(s), int(y)) for i, (s, y) in enumerate(zip(scores, labels))],
        "g STRING, customer_id BIGINT, score DOUBLE, y INT")


@pytest.mark.parametrize("rows", [None, 1])
def test_auc_ties_count_half(spark, rows):
    df = _scored(spark, [1, 1, 1, 2], [0, 1, 0, 1])
    r = M.exact_auc(df, ["g"], rows_per_bucket=rows).first()
    assert r.auc == pytest.approx(0.75)
    assert (r.n_pos, r.n_neg) == (2, 2)


@pytest.mark.parametrize("rows", [None, 1])
def test_auc_constant_label_is_null(spark, rows):
    df = _scored(spark, [0.1, 0.2, 0.3], [0, 0, 0])
    assert M.exact_auc(df, ["g"], rows_per_bucket=rows).first().auc is None


def test_macro_skips_null(spark):
    aucs = spark.createDataFrame([("a", "t1", 0.8), ("a", "t2", None), ("a", "t3", 0.6)],
                                 "source STRING, target STRING, auc DOUBLE")
    r = M.macro_auc(aucs, ["source"]).first()
    assert r.n_scored == 2 and r.macro_auc == pytest.approx(0.7)


@pytest.mark.parametrize("rows", [None, 1])
def test_rank_normalize_ties_and_single(spark, rows):
    df = _scored(spark, [1, 1, 2, 3], [0, 0, 0, 0])
    got = sorted(r.rank_score for r in rank_normalize(df, ["g"], rows_per_bucket=rows).collect())
    assert got == pytest.approx([0, 1 / 3, 2 / 3, 1])
    one = _scored(spark, [5], [0])
    assert rank_normalize(one, ["g"], rows_per_bucket=rows).first().rank_score == 0.0


@pytest.mark.parametrize("rows", [None, 1])
def test_rank_average(spark, rows):
    df = _scored(spark, [1, 1, 2, 3], [0, 0, 0, 0])
    got = {r.customer_id: r.rank_avg for r in rank_average(df, ["g"], rows_per_bucket=rows).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == pytest.approx([0.375, 0.375, 0.75, 1.0])


def test_buckets_agree_with_one_window_on_real_sources(spark, ctx):
    key = ["split", "source", "target"]
    one = Window.partitionBy(*key)
    want = ctx.preds.select(*key, "customer_id", F.round(
        (F.row_number().over(one.orderBy("score", h("tie", "customer_id"), "customer_id")) - 1)
        / (F.count(F.lit(1)).over(one) - 1), 12).alias("r"))
    for rows in (None, 30):
        got = rank_normalize(ctx.preds, key, rows_per_bucket=rows)
        assert want.exceptAll(got.select(*key, "customer_id",
                                         F.round("rank_score", 12).alias("r"))).count() == 0
    x = M.exact_auc(ctx.oof_scored(), ["target", "source"])
    y = M.exact_auc(ctx.oof_scored(), ["target", "source"], rows_per_bucket=10)
    assert x.exceptAll(y).count() == 0 and x.count() == y.count()
    assert all(r.auc is None for r in x.filter("target = 'target_9_9'").collect())


def test_hash_positions_match_one_window(spark, ctx):
    w = Window.partitionBy("target", "y").orderBy(h("s", "customer_id"), "customer_id")
    want = ctx.labels.select("target", "customer_id", (F.row_number().over(w) - 1).cast(
        "bigint").alias("pos"))
    for rows in (None, 10):
        got = hash_positions(ctx.labels, ["target", "y"], "s", rows_per_bucket=rows)
        assert want.exceptAll(got.select("target", "customer_id", "pos")).count() == 0


def test_auc_of_billions_neither_overflows_nor_drifts(spark):
    big = 4_000_000_000
    df = spark.createDataFrame([("g", 0.1, 0, big), ("g", 0.2, big, 0), ("h", 0.5, big, big)],
                               "g string, _s double, p long, n long")
    got = {r.g: r.auc for r in M.auc_from_counts(df, ["g"]).collect()}
    assert got == {"g": 1.0, "h": 0.5}


def test_weights_of_any_width_are_applied(spark):
    preds = spark.createDataFrame([("oof", "t", 1, f"s{i}", 1.0) for i in range(4)],
                                  "split string, target string, customer_id long, source string, "
                                  "score double")
    weights = spark.createDataFrame([("t", f"s{i}", i + 1, 0.25) for i in range(4)],
                                    "target string, source string, rank int, weight double")
    assert [r.score for r in R.apply_weights(preds, weights).collect()] == [1.0]
    labels = spark.createDataFrame([("t", 1, 0), ("bare", 1, 0)],
                                   "target string, customer_id long, y int")
    with pytest.raises(ValueError, match="bare"):
        R.require_covered(labels, preds)


def test_submission_that_does_not_fit_raises(spark):
    sample = spark.createDataFrame([(1,), (2,)], "customer_id long")
    whole = spark.createDataFrame([(1, 0.5), (2, 0.1)], "customer_id long, p double")
    assert assemble_submission(sample, whole, ["p"]).count() == 2
    with pytest.raises(ValueError, match="columns"):
        assemble_submission(sample, whole, ["p", "q"])
    for bad in (whole.limit(1), whole.union(spark.createDataFrame([(3, 0.1)], whole.schema)),
                whole.withColumn("p", F.lit(None).cast("double"))):
        with pytest.raises(ValueError, match="sample"):
            assemble_submission(sample, bad, ["p"])


def test_simplex_grid_shapes(spark):
    g2 = B.simplex_grid(spark, 2, 0.05).orderBy("grid_id").collect()
    g3 = B.simplex_grid(spark, 3, 0.05).orderBy("grid_id").collect()
    assert len(g2) == 21 and len(g3) == 231
    assert (g2[0].w_0, g2[0].w_1) == (0.0, 1.0)
    assert (g3[0].w_0, g3[0].w_1, g3[0].w_2) == (0.0, 0.0, 1.0)
    assert all(math.isclose(r.w_0 + r.w_1 + r.w_2, 1.0) for r in g3)
    assert B.simplex_grid_size(3) == 231


def test_manifest_load_checks_labels_and_columns(spark, tmp_path):
    from stackrank.sources.predictions import load_sources
    spark.createDataFrame([(1, 0.5)], "customer_id long, target_a double").write.parquet(
        str(tmp_path / "oof"))
    spark.createDataFrame([(2, 0.4, 0.3)], "customer_id long, predict_a double, predict_b double"
                          ).write.parquet(str(tmp_path / "test"))
    entry = ("s", str(tmp_path / "oof"), str(tmp_path / "test"), ["target_a", "target_b"])
    with pytest.raises(ValueError, match="target_b"):
        load_sources(spark, [entry])
    with pytest.raises(ValueError, match="duplicate"):
        load_sources(spark, [entry, entry])
    got = sorted(tuple(r) for r in load_sources(spark, [entry], "skip").collect())
    assert got == [("oof", "s", "target_a", 1, 0.5), ("test", "s", "target_a", 2, 0.4),
                   ("test", "s", "target_b", 2, 0.3)]


def test_rank_ranges_split_a_tied_score_and_keep_order(spark):
    """A score that most rows share is cut into several ranges; positions, ties by equal hashes
    and null, NaN and infinite scores are those of one window, in a null group too."""
    inf, nan = float("inf"), float("nan")
    odd = [None, nan, inf, -inf, 0.0, -0.0]
    rows = [(None if i % 7 == 0 else "g", i % 400, 0.5 if i % 10 else odd[i // 10 % 6])
            for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, customer_id long, score double").repartition(5)
    w = Window.partitionBy("g")
    want = df.select("*", F.round(
        (F.row_number().over(w.orderBy("score", h("tie", "customer_id"), "customer_id")) - 1)
        / (F.count(F.lit(1)).over(w) - 1), 12).alias("r"))
    mean = df.select("*", F.round((F.rank().over(w.orderBy("score")) + (F.count(F.lit(1)).over(
        Window.partitionBy("g", "score")) - 1) / 2.0) / F.count(F.lit(1)).over(w), 12).alias("r"))
    for n in (None, 50):
        got = rank_normalize(df, ["g"], rows_per_bucket=n).select(
            *df.columns, F.round("rank_score", 12).alias("r"))
        assert want.exceptAll(got).count() == 0 and got.count() == 6000
        got = rank_average(df, ["g"], rows_per_bucket=n).select(
            *df.columns, F.round("rank_avg", 12).alias("r"))
        assert mean.where("score IS NOT NULL").exceptAll(got).count() == 0


def test_no_range_of_a_tied_score_holds_a_fifth_of_its_rows(spark):
    """The rows of one score went into one task when their average rank was joined to them."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").alias("customer_id"),
                                    F.when(F.col("id") % 10 == 0, F.col("id") / 1e5).otherwise(
                                        0.5).alias("score"))
    ranges = RK._Ranges(df, ["g"], "score", "customer_id", F.xxhash64("customer_id").bitwiseAND(
        F.lit((1 << 32) - 1)), 500)
    most = ranges.rows.groupBy("_k").count().agg(F.max("count")).first()[0]
    assert most < 3_600


def test_shared_scores_are_ranked_as_the_long_table(spark, ctx):
    from stackrank.sources import predictions as P
    key = ["split", "source", "target", "customer_id", "score"]
    named = P.named_cells(P.score_cells(ctx.scores)).select(*key)
    long = ctx.preds.select(*key)
    assert named.exceptAll(long).count() == 0 and long.exceptAll(named).count() == 0


def test_routed_sums_are_plain_aggregates(spark):
    """Lists of terms are gathered by object aggregates, which sort all predictions."""
    preds = spark.createDataFrame(
        [("oof", "t", c, f"s{i}", None if (c, i) == (2, 1) else 0.1 * (c + i))
         for c in (1, 2) for i in range(3)] + [("oof", "t", 1, "s2", 0.7)],
        "split string, target string, customer_id long, source string, score double")
    weights = spark.createDataFrame([("t", f"s{i}", 3 - i, w) for i, w in enumerate((.2, .3, .5))],
                                    "target string, source string, rank int, weight double")
    got = R.apply_weights(preds, weights)
    assert "Object" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.customer_id: r.score for r in got.collect()} == {
        1: pytest.approx(.5 * (.3 + .7) + .3 * .2 + .2 * .1), 2: pytest.approx(.5 * .4 + .2 * .2)}


def test_sources_are_written_without_a_sort(spark, tmp_path):
    from stackrank.sources import predictions as P
    df = spark.createDataFrame([(f"s{i % 3}", i) for i in range(300)], "source string, v long"
                               ).coalesce(1)
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with P.open_writers(spark, 3):
        assert int(spark.conf.get(name)) >= 3
        df.write.partitionBy("source").parquet(str(tmp_path / "x"))
    assert spark.conf.get(name) == before
    back = spark.read.parquet(str(tmp_path / "x")).select("source", "v")
    assert df.exceptAll(back).count() == 0 and back.count() == 300
