"""Literal edge-case fixtures (FIXTURES section 3)."""

import pytest
from pyspark.sql import functions as F

from stackrank.operators import encode as EN
from stackrank.operators import profile as PR
from stackrank.operators import report as RP
from stackrank.operators import route as R
from stackrank.operators.metrics import target_rates
from stackrank.operators.rowstats import row_stats, row_zeros


def test_row_stats_nulls_and_zeros(spark):
    df = spark.createDataFrame([(1, [None, 0.0, 4.0]), (2, [None, None])],
                               "customer_id BIGINT, extra ARRAY<DOUBLE>")
    r = {x.customer_id: x for x in row_stats(df).collect()}
    a = r[1]
    assert (a.row_extra_mean, a.row_extra_min, a.row_extra_max, a.row_extra_sum) == (2.0, 0.0, 4.0, 4.0)
    assert (a.row_extra_null_count, a.row_extra_zero_count) == (1.0, 2.0)
    assert a.row_extra_null_share == pytest.approx(1 / 3)
    assert a.row_extra_zero_share == pytest.approx(2 / 3)
    b = r[2]
    assert b.row_extra_mean is None and b.row_extra_min is None and b.row_extra_max is None
    assert b.row_extra_sum == 0.0 and b.row_extra_zero_count == 2.0
    z = {x.customer_id: x.row_zeros for x in row_zeros(df).collect()}
    assert z[1] == 1   # nulls are not zeros in the early variant


def test_half_even_quantize(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (0.125,)], "x DOUBLE")
    q = EN.quantize(df, ["x"], [0, 2]).collect()
    assert [r.x_q0 for r in q[:3]] == [0.0, 2.0, 2.0]
    assert q[3].x_q2 == 0.12


def test_numeric_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "s STRING")
    got = [r[0] for r in df.select(EN.numeric_coerce(F.col("s"))).collect()]
    assert got == [1.5, None, None]


def test_category_codes_first_appearance(spark):
    rows = [(1, "b"), (2, None), (3, "a"), (4, "c"), (5, "a")]
    df = spark.createDataFrame([(i, "f", v) for i, v in rows], "customer_id BIGINT, feature STRING, value STRING")
    codes = {r.value_text: r.code for r in EN.category_codes(df).collect()}
    assert codes == {"b": 0, "__MISSING__": 1, "a": 2, "c": 3}


def test_variance_null_as_zero_and_distinct(spark):
    el = spark.createDataFrame([(1, 0, 0, None), (2, 0, 0, 2.0)],
                               "customer_id BIGINT, is_test INT, pos INT, value DOUBLE")
    dic = spark.createDataFrame([(0, "f")], "pos INT, feature STRING")
    assert PR.variance_ranking(el, dic).first().variance == pytest.approx(2.0)
    el2 = spark.createDataFrame([(i, 0, 0, v) for i, v in enumerate([1.0, 1.0, None, 2.0])],
                                "customer_id BIGINT, is_test INT, pos INT, value DOUBLE")
    assert PR.distinct_counts(el2, dic).first().n_unique == 2


def test_rate_null_as_zero(spark):
    lab = spark.createDataFrame([(1, "t", 1), (2, "t", None)], "customer_id BIGINT, target STRING, y INT")
    assert target_rates(lab).first().rate == 0.5


def test_smoothing_unseen_gets_global_mean(spark):
    train = spark.createDataFrame([(1, "t", "a", 0, 1), (2, "t", "a", 1, 0), (3, "t", "b", 0, 1)],
                                  "customer_id BIGINT, target STRING, value STRING, fold INT, y INT")
    test = spark.createDataFrame([(9, "t", "zzz")], "customer_id BIGINT, target STRING, value STRING")
    _, te = EN.oof_target_encoding(train, test, ["target"], alpha=20.0)
    assert te.first().enc == pytest.approx(2 / 3)


def _ordered(spark, aucs):
    rows = [("t", f"s{i}", i, a, False, i + 1) for i, a in enumerate(aucs)]
    return spark.createDataFrame(rows, "target STRING, source STRING, position INT, auc DOUBLE, "
                                       "is_constant BOOLEAN, ord INT")


def test_min_delta_filter(spark):
    o = _ordered(spark, [0.80, 0.79, 0.70])
    assert R.candidate_pool(o, "top2_weighted", 0.02).count() == 2
    assert R.candidate_pool(o, "top2_weighted", 0.001).count() == 2   # width kept
    assert R.candidate_pool(o, "winner", 0.001).count() == 1


def test_target_groups_cap(spark):
    rates = spark.createDataFrame([("a", 0.5), ("b", 0.005), ("c", 0.002)], "target STRING, rate DOUBLE")
    scores = spark.createDataFrame([("a", 0.9)], "target STRING, auc DOUBLE")
    g = {(r.grp, r.target) for r in RP.target_groups(rates, scores, 1, 0, 0.01).collect()}
    assert ("rare", "c") in g
    rates2 = spark.createDataFrame([("a", 0.5), ("b", 0.3)], "target STRING, rate DOUBLE")
    g2 = {(r.grp, r.target) for r in RP.target_groups(rates2, scores, 1, 0, 0.01).collect()}
    assert ("rare", "b") in g2   # cap ignored when nobody passes it


def test_promotion_rule(spark):
    board = spark.createDataFrame([("base", 0.0), ("a", 0.0010), ("b", 0.0007), ("c", 0.0007), ("d", 0.0004)],
                                  "run STRING, d_oof DOUBLE")
    gains = spark.createDataFrame([("b", "t", 1)] * 12 + [("c", "t", 1)] * 11,
                                  "run STRING, target STRING, is_gain INT")
    got = {r.run: r.decision for r in RP.promotion(board, gains, "base").collect()}
    assert got == {"a": "strong", "b": "conditional", "c": "reject", "d": "reject"}


def test_pearson_constant_is_null(spark):
    lab = spark.createDataFrame([(i, t, y) for i in range(4) for t, y in (("x", 1), ("z", i % 2))],
                                "customer_id BIGINT, target STRING, y INT")
    assert RP.phi_pairs(lab).first().corr_abs is None


@pytest.mark.parametrize("vals,expect", [([3.0, 1.0, 2.0], 2.0), ([4.0, 1.0, 2.0, 3.0], 2.5),
                                         ([5.0, 5.0, 1.0, None], 5.0), ([7.0], 7.0)])
def test_exact_median(spark, vals, expect):
    df = spark.createDataFrame([(0, v) for v in vals], "pos INT, value DOUBLE")
    assert EN.exact_median(df).first().med == expect


def test_score_report_unparsable_macro_is_null(spark, tmp_path):
    from stackrank.sources import reports as RS
    p = str(tmp_path / "rep")
    with open(tmp_path / "rep.json", "w") as f:
        f.write('{"model": "a", "macro_auc": "abc", "target_scores": {"t1": 0.7}}\n')
        f.write('{"model": "b", "target_scores": {"t1": 0.6, "t2": null}}\n')
        f.write('{"model": "c", "macro_auc": 0.75, "target_scores": {"t1": 0.8}}\n')
    got = RS.read_target_scores(spark, str(tmp_path / "rep.json")).collect()
    macro = {r.model: r.macro_auc for r in got}
    assert macro == {"a": None, "b": None, "c": 0.75}
    assert len(got) == 4
    del p


def test_duplicate_manifest_label_is_error(spark):
    from stackrank.sources.predictions import check_manifest
    m = spark.createDataFrame([("a", 0), ("a", 1)], "source STRING, position INT")
    with pytest.raises(ValueError):
        check_manifest(m)
