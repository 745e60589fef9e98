"""Fold properties: every train row once, strata balanced to one row."""

from pyspark.sql import functions as F

from stackrank.operators import folds as FO


def test_every_row_once(ctx):
    f = ctx.folds
    assert f.count() == ctx.labels.select("customer_id").distinct().count()
    assert f.groupBy("customer_id").count().filter("count > 1").count() == 0
    assert {r.fold for r in f.select("fold").distinct().collect()} == set(range(5))


def test_strata_balanced(ctx):
    strata = FO.multilabel_strata(ctx.labels)
    sizes = (strata.join(ctx.folds, "customer_id").groupBy("stratum", "fold").count()
                   .groupBy("stratum").agg((F.max("count") - F.min("count")).alias("spread")))
    assert sizes.agg(F.max("spread")).first()[0] <= 1


def test_same_seed_same_folds(ctx):
    a = FO.multilabel_folds(ctx.labels, seed=7)
    b = FO.multilabel_folds(ctx.labels, seed=7)
    assert a.exceptAll(b).count() == 0
