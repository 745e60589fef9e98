"""Properties of model-based operators and the streaming scorer (sf0.001)."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from stackrank.operators import metrics as M
from stackrank.operators import sampling as SA
from stackrank.streaming import read_scores, start_scoring
from tests.conftest import SF_SMALL


def test_oof_linear_scores_every_train_row_once(spark, ctx):
    preds = E.queries()["oof_linear"](spark, SF_SMALL)
    oof = preds.filter("split = 'oof'")
    assert oof.count() == ctx.labels.count()
    assert oof.groupBy("target", "customer_id").count().filter("count > 1").count() == 0
    n_test = ctx.mart.filter("is_test = 1").count()
    test = preds.filter("split = 'test'").groupBy("target").count().collect()
    assert all(r["count"] == n_test for r in test)
    aucs = {r.target: r.auc for r in M.exact_auc(oof.join(ctx.labels, ["target", "customer_id"]),
                                                 ["target"]).collect()}
    assert aucs["target_9_9"] is None
    assert aucs["target_1_1"] > 0.6        # planted signal: line counts


def test_bag_quotas_exact(spark, ctx):
    bags = SA.bag_sample(ctx.labels, ctx.folds, n_bags=2, ratio=3.0)
    lf = ctx.labels.join(ctx.folds, "customer_id")
    for r in bags.filter("y = 0").groupBy("target", "fold", "bag").count().collect():
        part = lf.filter((F.col("target") == r.target) & (F.col("fold") != r.fold))
        p = part.filter("y = 1").count()
        n = part.filter("y = 0").count()
        expect = n if p == 0 or n == 0 else min(max(1, round(p * 3.0)), n)
        assert r["count"] == expect


def test_sample_random_deterministic(spark, ctx):
    ids = ctx.mart.select("customer_id")
    a = SA.sample_random(ids, 100, seed=5)
    b = SA.sample_random(ids, 100, seed=5)
    assert a.count() == 100 and a.exceptAll(b).count() == 0


def test_stream_scores_equal_batch(spark, ctx):
    base = tempfile.mkdtemp(prefix="stackrank-stream-test-")
    pred_dir, score_dir = os.path.join(base, "p"), os.path.join(base, "s")
    ctx.preds.write.partitionBy("source").parquet(pred_dir)
    start_scoring(spark, pred_dir, ctx.labels, score_dir, os.path.join(base, "c")).awaitTermination()
    got = read_scores(spark, score_dir)
    want = M.exact_auc(ctx.oof_scored(), ["target", "source"])
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["target", "grid_id", "w_0", "w_1", "auc"]


def test_sample_random_is_the_hash_prefix(spark, ctx):
    from stackrank.functions.hashing import h
    ids = ctx.mart.select("customer_id")
    want = [r.customer_id for r in ids.orderBy(h("sample3", "customer_id"), "customer_id")
            .limit(300).collect()]
    assert sorted(r.customer_id for r in SA.sample_random(ids, 300, seed=3).collect()) == sorted(want)
    assert SA.sample_random(ids, 10**9).count() == ids.count()
