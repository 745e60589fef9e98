"""Every skew-safe operator gives the same answer however many buckets a group has."""

import pytest

import __spark_entry__ as E
from stackrank.operators import positions
from tests.conftest import SF_SMALL

NAMES = ["fold_single", "auc_by_source", "rank_normalize", "rank_average", "blend_search",
         "sample_stratified", "shuffle_column", "impute_median", "hpo_eval", "route_top2",
         "cat_codes", "fold_assign"]


@pytest.mark.parametrize("name", NAMES)
def test_buckets_do_not_change_results(spark, ctx, name, monkeypatch):
    q = E.queries()[name]
    base = q(spark, SF_SMALL).collect()
    monkeypatch.setattr(positions, "ROWS_PER_BUCKET", 20)
    split = q(spark, SF_SMALL).collect()

    def norm(rows):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert norm(base) == norm(split)
