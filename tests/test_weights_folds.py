"""Projection onto bounded weights, refined weights, greedy folds on label combinations."""

import numpy as np
import pytest

from stackrank.operators import folds as FO
from stackrank.operators import route as R
from stackrank.operators.metrics import exact_auc


@pytest.mark.parametrize("n", [2, 3, 5])
def test_projection_is_the_nearest_point(n):
    rng = np.random.default_rng(n)
    for _ in range(30):
        w, lo, hi = rng.standard_normal(n) * 0.6 + 0.3, 0.01, 0.8
        p = R.bounded_projection(w, lo, hi)
        assert p.sum() == pytest.approx(1) and (p >= lo - 1e-12).all() and (p <= hi + 1e-12).all()
        best = ((p - w) ** 2).sum()
        for _ in range(300):                              # no feasible point is nearer
            q = np.clip(rng.dirichlet(np.ones(n)), lo, hi)
            q = R.bounded_projection(q, lo, hi)
            assert ((q - w) ** 2).sum() >= best - 1e-9
    inside = np.full(n, 1.0 / n)
    assert R.bounded_projection(inside, 0.01, 0.9) == pytest.approx(inside)
    with pytest.raises(ValueError):
        R.bounded_projection(w, 0.6, 0.9)


def test_refined_weights_rise_above_the_grid(spark):
    rng = np.random.default_rng(5)
    n, rows, labels = 600, [], []
    for t, mix in (("a", (0.62, 0.23, 0.15)), ("b", (0.1, 0.5, 0.4)), ("flat", (1, 0, 0))):
        s = rng.random((n, 3))
        y = (s @ np.array(mix) + 0.1 * rng.standard_normal(n) > 0.55).astype(int) * (t != "flat")
        rows += [(t, f"s{j}", i, float(s[i, j])) for i in range(n) for j in range(3)]
        labels += [(i, t, int(y[i])) for i in range(n)]
    rows += [("one", "s0", i, float(v)) for i, v in enumerate(rng.random(n))]
    labels += [(i, "one", i % 2) for i in range(n)]
    oof = spark.createDataFrame(rows, "target string, source string, customer_id int, score double")
    lab = spark.createDataFrame(labels, "customer_id int, target string, y int")
    start = spark.createDataFrame(
        [(t, f"s{j}", j + 1, w) for t in ("a", "b", "flat") for j, w in enumerate((0.4, 0.3, 0.3))]
        + [("one", "s0", 1, 1.0)], "target string, source string, rank int, weight double")
    got = R.refined_weights(start, oof, lab, alpha=0.01).collect()
    by = {}
    for r in got:
        by.setdefault(r.target, []).append(r)
    assert [r.weight for r in by["one"]] == [1.0] and by["one"][0].objective is None
    assert [r.weight for r in by["flat"]] == [0.4, 0.3, 0.3]
    for t in ("a", "b"):
        w = np.array([r.weight for r in sorted(by[t], key=lambda r: r.rank)])
        assert w.sum() == pytest.approx(1) and (w >= 0.01).all() and (w <= 0.99).all()
        scored = R.apply_weights(oof.selectExpr("'oof' split", "*"), spark.createDataFrame(
            [(r.target, r.source, r.rank, r.weight) for r in by[t]],
            "target string, source string, rank int, weight double")).join(lab, ["target", "customer_id"])
        auc = exact_auc(scored, ["target"], score_digits=None).first()["auc"]
        assert by[t][0].objective == pytest.approx(auc - 0.01 * ((w - 1 / 3) ** 2).sum(), abs=1e-9)
        first = R.apply_weights(oof.selectExpr("'oof' split", "*"), start.where(f"target = '{t}'"))
        begin = exact_auc(first.join(lab, ["target", "customer_id"]), ["target"],
                          score_digits=None).first()["auc"] - 0.01 * (0.4 - 1 / 3) ** 2 - 0.02 * (
                              0.3 - 1 / 3) ** 2
        assert by[t][0].objective > begin
    assert max(by["a"], key=lambda r: r.weight).source == "s0"


@pytest.mark.parametrize("seed", range(6))
def test_quotas_spread_every_target(seed):
    rng = np.random.default_rng(seed)
    t, k = 7, 5
    rates = np.array([0.4, 0.2, 0.1, 0.05, 0.02, 0.005, 0.0])
    y = (rng.random((3000, t)) < rates).astype(int)
    y[:, 3] |= y[:, 2]                                    # nested labels
    has, counts = np.unique(y, axis=0, return_counts=True)
    q = FO.combination_quotas(counts, has, k)
    assert (q.sum(axis=1) == counts).all() and (q >= 0).all()
    assert (abs(q - counts[:, None] / k) < 1).all()
    pos = has.T @ q
    assert (abs(pos - (has.T @ counts)[:, None] / k) <= 1).all(), pos
    assert q.sum(axis=0).max() - q.sum(axis=0).min() <= k


def test_greedy_folds(spark):
    rng = np.random.default_rng(1)
    y = (rng.random((800, 3)) < (0.3, 0.05, 0.01)).astype(int)
    lab = spark.createDataFrame([(i, f"t{j}", int(y[i, j])) for i in range(800) for j in range(3)],
                                "customer_id int, target string, y int")
    got = {r.customer_id: r.fold for r in FO.greedy_folds(lab).collect()}
    assert len(got) == 800 and set(got.values()) == set(range(5))
    again = {r.customer_id: r.fold for r in FO.greedy_folds(lab.repartition(7)).collect()}
    assert got == again
    fold = np.array([got[i] for i in range(800)])
    for j in range(3):
        pos = np.bincount(fold[y[:, j] == 1], minlength=5)
        assert (abs(pos - y[:, j].sum() / 5) <= 1).all()


def test_refined_weights_go_on_while_the_objective_rises(spark):
    """the rounds of a move end when no target improves, not after a number of them."""
    rng = np.random.default_rng(11)
    s = rng.random((400, 2))
    y = (s[:, 1] > 0.5).astype(int)
    oof = spark.createDataFrame([("a", f"s{j}", i, float(s[i, j])) for i in range(400)
                                 for j in range(2)],
                                "target string, source string, customer_id int, score double")
    lab = spark.createDataFrame([(i, "a", int(v)) for i, v in enumerate(y)],
                                "customer_id int, target string, y int")
    start = spark.createDataFrame([("a", "s0", 1, 0.9), ("a", "s1", 2, 0.1)],
                                  "target string, source string, rank int, weight double")
    got = {r.source: r for r in R.refined_weights(start, oof, lab, alpha=0.0).collect()}
    assert got["s1"].weight > 0.8 and got["s1"].objective > 0.97


def blend_rows(spark, n=5000, seed=3, missing=0.05):
    """(target, y, r_0, r_1, r_2) with ties, rows without a score and rows without a label."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in ("a", "b"):
        r = np.round(rng.random((n, 3)), 2 if t == "a" else 12)
        y = (r[:, 0] + rng.random(n) > 1).astype(int)
        gone, bare = rng.random((n, 3)) < missing, rng.random(n) < missing
        rows += [(t, None if bare[i] else int(y[i]), *[None if gone[i, j] else float(r[i, j])
                                                       for j in range(3)]) for i in range(n)]
    return spark.createDataFrame(rows, "target string, y int, r_0 double, r_1 double, r_2 double")


@pytest.mark.parametrize("digits", [None, 3])
def test_packed_blends_are_the_exact_aucs(spark, digits):
    from pyspark.sql import functions as F

    from stackrank.operators.blends import Blends
    from stackrank.sources.context import cut
    wide = cut(blend_rows(spark).repartition(5))
    grid = [(1, [0.2, 0.3, 0.5]), (2, [1.0, 0.0, 0.0]), (3, [0.1, 0.1, 0.8]), (4, [0.7, 0.2, 0.1])]
    points = {"a": grid, "b": grid[1:]}
    rows = Blends(wide, points, ["r_0", "r_1", "r_2"], F.col("r_0").isNull(), digits)
    got = {(r["target"], r["point"]): r for r in rows.aucs(points, rows_per_bucket=500).collect()}
    bounds = rows.bounds(points, 64)
    assert set(got) == set(bounds) == {(t, i) for t, v in points.items() for i, _ in v}
    for i, w in grid:
        score = F.lit(w[0]) * F.col("r_0")
        for j in (1, 2):
            score = score + F.lit(w[j]) * F.coalesce(f"r_{j}", F.lit(0.0))
        score = score if digits is None else F.round(score, digits)
        for r in exact_auc(wide.select("target", "y", score.alias("score")), ["target"],
                           score_digits=None).collect():
            if (r["target"], i) in got:
                mine = got[r["target"], i]
                assert (mine["n_pos"], mine["n_neg"], mine["auc"]) == (
                    r["n_pos"], r["n_neg"], r["auc"])
                low, high = bounds[r["target"], i]
                assert low <= r["auc"] + 1e-12 and r["auc"] <= high + 1e-12
    left = rows.contenders(points, 64, lambda t, i: 0.0)
    for t, v in points.items():
        best = max(v, key=lambda p: got[t, p[0]]["auc"])[0]
        assert best in [i for i, _ in left[t]]


def test_rounding_is_half_up_on_decimals(spark):
    from pyspark.sql import functions as F

    from stackrank.operators.blends import half_up
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.random(500), rng.integers(0, 10 ** 9, 500) / 1e9 + 5e-10, -rng.random(50),
                        [0.0, -0.0, 1.0000000005, 12345678.1234567895, 3e20, 0.1234567885]])
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in v], "v double").select(
        F.round("v", 9)).collect()]
    assert half_up(v, 9).tolist() == got
