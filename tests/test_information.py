"""Nearest-neighbour mutual information against its definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackrank.operators import profile as PR


def brute(x, y, k=PR.MI_NEIGHBOURS):
    """Row by row, with all distances."""
    n_class = {c: int((y == c).sum()) for c in set(y.tolist())}
    rows = [i for i in range(len(x)) if n_class[y[i]] > 1]

    def psi(n):
        return sum(1.0 / i for i in range(1, n)) - 0.5772156649015329
    total = 0.0
    for i in rows:
        inside = sorted(abs(x[j] - x[i]) for j in rows if j != i and y[j] == y[i])
        kk = min(k, len(inside))
        r = inside[kk - 1]
        near = sum(x[i] - r < x[j] < x[i] + r for j in rows)
        total += psi(kk) - psi(n_class[y[i]]) - psi(max(near, 1))
    return max(0.0, psi(len(rows)) + total / len(rows)) if rows else 0.0


@pytest.mark.parametrize("n,rate", [(60, 0.5), (200, 0.1), (80, 1.0), (40, 0.05), (5, 0.5), (2, 0.5)])
def test_information_is_brute_force(n, rate):
    rng = np.random.default_rng(n)
    y = (rng.random(n) < rate).astype(int)
    x = rng.standard_normal(n) + y
    assert PR.neighbour_information(x, y) == pytest.approx(brute(x, y), abs=1e-10)


def test_one_row_of_a_class_takes_no_part():
    x, y = np.array([0.1, 0.2, 0.4, 0.8, 5.0]), np.array([0, 0, 0, 0, 1])
    assert PR.neighbour_information(x, y) == PR.neighbour_information(x[:4], y[:4]) == 0.0
    assert PR.neighbour_information(x[:1], y[:1]) == 0.0


def test_information_over_tables(spark):
    rng = np.random.default_rng(3)
    n = 800
    y = rng.integers(0, 2, n)
    rows = [(i, [float(y[i] * 2 + rng.standard_normal()), float(rng.standard_normal()),
                 None if i % 3 else 1.0]) for i in range(n)]
    mart = spark.createDataFrame(rows, "customer_id long, v array<double>")
    labels = spark.createDataFrame([(i, "t", int(y[i])) for i in range(n)]
                                   + [(i, "none", 0) for i in range(n)],
                                   "customer_id long, target string, y int")
    values = PR.numeric_values(mart, ["signal", "noise", "ties"], F.col("v"))
    assert values.count() == 3 * n and values.select("feature", "x").distinct().count() == 3 * n
    got = {(r.target, r.feature): r.mi for r in PR.numeric_information(values, labels).collect()}
    assert got[("t", "signal")] > 0.2 > 0.05 > max(got[("t", "noise")], got[("t", "ties")])
    # a bound x - r or x + r may round onto the neighbour itself: a row or two count one off
    assert max(got[("none", f)] for f in ("signal", "noise", "ties")) < 0.005
    by = {f: sorted((r.customer_id, r.x) for r in values.collect() if r.feature == f)
          for f in ("signal",)}
    x = np.array([v for _, v in by["signal"]])
    assert got[("t", "signal")] == pytest.approx(brute(x[:n], y), abs=1e-9)


def test_few_distinct_values(spark):
    nan = float("nan")
    rows = [(i, [float(i % 3), float(i), None if i % 2 else 1.0, [nan, 0.0, -0.0][i % 3], None,
                 float(i % 50), float(i % 51)]) for i in range(600)]
    mart = spark.createDataFrame(rows, "customer_id long, extra array<double>").repartition(5)
    dic = spark.createDataFrame([(j, f"f{j}") for j in range(7)], "pos int, feature string")
    got = {r.feature: r.n_unique for r in PR.few_distinct(mart, dic).collect()}
    assert got == {"f0": 3, "f2": 1, "f3": 2, "f5": 50}
    whole = PR.distinct_counts(mart.select(F.posexplode("extra").alias("pos", "value")), dic)
    assert {r.feature: r.n_unique for r in whole.collect() if 0 < r.n_unique <= 50} == got
    assert PR.few_distinct(mart.limit(0), dic).count() == 0
