"""The audit on arrays: packed AUCs equal the row-wise ones, and no score becomes a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackrank.operators import audit as AU
from stackrank.operators import metrics as M
from stackrank.operators import packed as PK
from stackrank.plans import audit_queries as AQ

TARGETS, WIDTH = ("a", "b"), 2
UNITS = ("trial INT, customer_id BIGINT, fold INT, l BIGINT, n ARRAY<BIGINT>, zs ARRAY<DOUBLE>, "
         "d ARRAY<DOUBLE>")


def _units(spark, n=400):
    """Scores with ties, labels 1, 0 and null, and a customer with two label rows now and then."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        l = 2 if i % 17 == 0 else 1
        y = rng.integers(0, 3, (l, 2))                         # class of each label row and target
        count = [int((y[:, t] == c).sum()) for c in range(3) for t in range(2)]
        z, d = rng.integers(-4, 5, 2) / 4.0, rng.integers(-4, 5, 2) / 4.0
        rows.append((i % 2, i, i % 3, l, count, z.tolist(), d.tolist()))
    return spark.createDataFrame(rows, UNITS), rows


def _weights():
    rng = np.random.default_rng(6)
    return {(t, f): rng.integers(-3, 4, (2, WIDTH)) / 8.0 + 0.5 for t in range(2) for f in range(3)}


def _long(rows, w, moved):
    out = []
    for trial, cid, fold, l, n, z, d in rows:
        for t in range(2):
            for c, y in enumerate((1, 0, None)):
                k = n[c * 2 + t]
                if k:
                    s = k * float(np.dot(w[trial, fold][t], z))
                    if moved:
                        out += [(trial, TARGETS[t], fold, j, s + float(w[trial, fold][t, j] * d[j]), y)
                                for j in range(WIDTH) for _ in range(l)]
                    else:
                        out.append((trial, TARGETS[t], fold, -1, s, y))
    return out


@pytest.mark.parametrize("moved", [False, True])
@pytest.mark.parametrize("per_bucket", [1_000_000, 1])
def test_packed_aucs_are_those_of_the_rows(spark, moved, per_bucket, monkeypatch):
    u, rows = _units(spark)
    w = _weights()
    monkeypatch.setattr(PK, "SAMPLE", 2)
    x = PK.Linear(w, 2, {0: [0, 1], 1: [0, 1]} if moved else None)
    keys = ["trial", "target", "fold", "pos"]
    got = PK.packed_auc(u, x, TARGETS, per_bucket)
    want = M.exact_auc(spark.createDataFrame(
        _long(rows, w, moved), "trial INT, target STRING, fold INT, pos INT, score DOUBLE, y INT"), keys)
    pairs = {tuple(r[k] for k in keys): r["auc"] for r in got.collect()}
    assert pairs == {tuple(r[k] for k in keys): r["auc"] for r in want.collect()}
    assert len(pairs) == (24 if moved else 12)
    if per_bucket == 1:
        assert PK._bounds(u, x, 1)                             # several ranges were merged


def test_packs_keep_values_and_counts():
    rng = np.random.default_rng(7)
    for v in (np.rint(rng.normal(size=999) * 1e9), rng.integers(-3, 3, 500).astype(float),
              np.array([1e300, -1e300, 0.0, 5.0]), np.empty(0)):
        a, c = np.unique(v, return_counts=True)
        b, d = PK.unpack(PK.pack(v))
        assert a.tolist() == b.tolist() and c.tolist() == d.tolist()
        e, g = PK.unpack(PK.pack(v, np.full(len(v), 300)))
        assert a.tolist() == e.tolist() and (300 * c).tolist() == g.tolist()


def test_a_repeated_customer_counts_as_in_the_joins(spark):
    """Two label rows and two feature rows of a customer: sums and pairs of both."""
    extra = [(1, 0, [1.0, None]), (1, 0, [3.0, None]), (2, 0, [5.0, 2.0]), (None, 0, [9.0, 2.0]),
             (3, 1, [0.0, 0.0])]
    mart = spark.createDataFrame(extra, "customer_id BIGINT, is_test INT, extra ARRAY<DOUBLE>")
    folds = spark.createDataFrame([(1, 0), (2, 1)], "customer_id BIGINT, fold INT")
    z = AU.standardized(mart, folds, WIDTH)
    v = np.array([1.0, 3.0, 5.0, 9.0])
    by = {(r["customer_id"], r["copy"]): r["zs"] for r in z.collect()}
    assert set(by) == {(1, 1), (1, 2), (2, 1)}
    assert [by[k][0] for k in sorted(by)] == pytest.approx((v[:3] - v.mean()) / v.std())
    assert [by[k][1] for k in sorted(by)] == [0.0, 0.0, 0.0]   # null, and a constant feature
    labels = spark.createDataFrame([(0, 1, [1, 0]), (0, 1, [1, None]), (0, 2, [0, 1]), (0, None, [0, 1])],
                                   "trial INT, customer_id BIGINT, ys ARRAY<INT>")
    u = {r["customer_id"]: r for r in AU.units(z, labels, 2, WIDTH).collect()}
    assert u[1]["l"] == 2 and u[1]["n"] == [2, 0, 0, 1, 0, 1] and set(u) == {1, 2}
    assert u[1]["zs"][0] == pytest.approx(by[1, 1][0] + by[1, 2][0])
    d = AU.shuffled_features(z)
    assert {r["customer_id"]: r["count"] for r in d.groupBy("customer_id").count().collect()} == {1: 4, 2: 1}


def test_baselines_need_no_permutation(ctx):
    a = AQ._Audit(ctx)
    assert a.base.count() == 35
    assert not {"_moved", "real", "null"} & set(vars(a))


def test_customers_not_scores_are_shuffled(ctx):
    """One row per customer enters the scoring; what leaves it are packs, a few per task."""
    a = AQ._Audit(ctx)
    u, w = a._real
    rows = u.join(a._moved, "customer_id")
    assert rows.count() == ctx.labels_array.count()
    x = PK.Linear(w, len(AQ.MT.TARGETS), {0: list(range(AQ.WIDTH))})
    got = PK.packed_auc(rows, x, AQ.MT.TARGETS, 1_000_000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan
    assert got.agg(F.count("auc")).first()[0] > 0
