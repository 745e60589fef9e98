"""DuckDB text of the shared building blocks (mart, labels, folds, sources).

Oracle queries are independent re-statements of each operator in plain SQL over
the driver's views; they share these CTEs. ``with_ctes(final, *names)`` emits a
``WITH`` clause holding the named blocks and everything they depend on.
"""

from __future__ import annotations

from stackrank.functions.hashing import sql_h
from stackrank.sources.mart import EXTRA_FEATURES, EXTRA_FLAGS, EXTRA_MEASURES, EXTRA_STATS, TARGETS
from stackrank.sources.predictions import SOURCE_ORDER, SPEC_TARGETS

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, deps: tuple[str, ...], sql: str) -> None:
    BLOCKS[name] = (deps, sql)


def with_ctes(final: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` the named blocks (and their dependencies), then ``extra`` inline CTEs
    given as (name, sql) pairs in order, then the final SELECT."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in BLOCKS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{BLOCKS[n][1]}\n)" for n in order]
    parts += [f"{n} AS (\n{sql}\n)" for n, sql in (extra or [])]
    if not parts:
        return final
    return "WITH " + ",\n".join(parts) + "\n" + final


def xi(feature: str) -> str:
    """1-based DuckDB list index of an extra feature."""
    return f"extra[{EXTRA_FEATURES.index(feature) + 1}]"


def targets_values() -> str:
    return ", ".join(f"('{t}')" for t in TARGETS)


# -- mart --------------------------------------------------------------------
_fn = {"sum": "sum", "max": "max", "min": "min", "avg": "avg"}
_li_aggs = [f"round({_fn[s]}(l_{m})::DOUBLE, 6) AS extra_{m}_{s}"
            for m in EXTRA_MEASURES for s in EXTRA_STATS]
_li_aggs += [f"count_if({c} = '{v}')::DOUBLE AS extra_{n}" for n, c, v in EXTRA_FLAGS]
block("li", (), "SELECT l_orderkey AS customer_id,\n  " + ",\n  ".join(_li_aggs)
      + "\nFROM lineitem GROUP BY l_orderkey")

block("mart", ("li",), f"""SELECT o.o_orderkey AS customer_id,
  CASE WHEN {sql_h('split', 'o.o_orderkey')} % 5 = 4 THEN 1 ELSE 0 END AS is_test,
  o.o_totalprice::DOUBLE AS num_feature_totalprice,
  c.c_acctbal::DOUBLE AS num_feature_acctbal,
  o.o_orderpriority AS cat_feature_priority,
  o.o_orderstatus AS cat_feature_status,
  c.c_mktsegment AS cat_feature_segment,
  c.c_nationkey AS cat_feature_nation,
  [{', '.join('li.' + f for f in EXTRA_FEATURES)}] AS extra
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN li ON li.customer_id = o.o_orderkey""")

block("extra_long", ("mart",), """SELECT customer_id, is_test,
  (generate_subscripts(extra, 1) - 1)::INTEGER AS pos, unnest(extra) AS value
FROM mart""")

block("dict", (), "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{f}')" for i, f in enumerate(EXTRA_FEATURES)) + ") t(pos, feature)")

_target_sql = {
    "target_1_1": f"coalesce({xi('extra_rf_r')}, 0) > 0",
    "target_1_2": f"coalesce({xi('extra_quantity_sum')}, 0) > 200",
    "target_2_1": "cat_feature_priority = '1-URGENT'",
    "target_2_2": "cat_feature_status = 'F' AND starts_with(cat_feature_priority, '1')",
    "target_3_1": "num_feature_totalprice > 490000",
    "target_3_2": ("cat_feature_priority = '1-URGENT' AND num_feature_totalprice > 450000 "
                   "AND cat_feature_status = 'P'"),
    "target_9_9": "false",
}
block("labels_wide", ("mart",), "SELECT customer_id,\n  " + ",\n  ".join(
    f"({_target_sql[t]})::INTEGER AS {t}" for t in TARGETS) + "\nFROM mart WHERE is_test = 0")
block("labels", ("labels_wide",), "SELECT customer_id, target, y FROM (UNPIVOT labels_wide ON "
      + ", ".join(TARGETS) + " INTO NAME target VALUE y)")

# -- folds (G2) ----------------------------------------------------------------
block("top2", ("labels",), """SELECT target, rk FROM (
  SELECT target, row_number() OVER (ORDER BY avg(y) DESC, target) AS rk
  FROM labels GROUP BY target) WHERE rk <= 2""")
block("strata0", ("labels", "top2"), """SELECT l.customer_id, sum(l.y) AS npos,
  concat_ws('_', sum(l.y)::VARCHAR, max(CASE WHEN t.rk = 1 THEN l.y END)::VARCHAR,
            max(CASE WHEN t.rk = 2 THEN l.y END)::VARCHAR) AS s_full
FROM labels l LEFT JOIN top2 t USING (target) GROUP BY l.customer_id""")
block("strata", ("strata0",), """SELECT customer_id,
  CASE WHEN (SELECT min(c) FROM (SELECT count(*) AS c FROM strata0 GROUP BY s_full)) < 5
       THEN npos::VARCHAR ELSE s_full END AS stratum
FROM strata0""")
block("folds", ("strata",), f"""SELECT customer_id, ((row_number() OVER (PARTITION BY stratum
  ORDER BY {sql_h('fold42', 'customer_id')}, customer_id) - 1) % 5)::INTEGER AS fold
FROM strata""")


# -- prediction sources ----------------------------------------------------------
def _te_source(name: str, col: str) -> None:
    block(f"{name}_vals", ("mart",),
          f"SELECT customer_id, is_test, {col}::VARCHAR AS value FROM mart")
    block(f"{name}_train", ("labels", "folds", f"{name}_vals"),
          f"""SELECT l.customer_id, l.target, f.fold, l.y, v.value
FROM labels l JOIN folds f USING (customer_id) JOIN {name}_vals v USING (customer_id)
WHERE v.is_test = 0""")
    block(f"{name}_stats", (f"{name}_train",),
          f"""SELECT target, value, fold, sum(y)::DOUBLE AS sy, count(*)::DOUBLE AS n,
  sum(sum(y)) OVER (PARTITION BY target, value)::DOUBLE AS ty,
  sum(count(*)) OVER (PARTITION BY target, value)::DOUBLE AS tn
FROM {name}_train GROUP BY target, value, fold""")
    block(f"{name}_gm", (f"{name}_stats",),
          f"SELECT target, sum(sy) / sum(n) AS gm FROM {name}_stats GROUP BY target")
    block(name, (f"{name}_stats", f"{name}_gm", f"{name}_train", f"{name}_vals"), f"""
SELECT 'oof' AS split, '{name}' AS source, t.target, t.customer_id,
  round(coalesce(((s.ty - s.sy) + g.gm * 20.0::DOUBLE) / ((s.tn - s.n) + 20.0::DOUBLE), g.gm), 9) AS score
FROM {name}_train t JOIN {name}_gm g USING (target)
LEFT JOIN {name}_stats s ON s.target = t.target AND s.value = t.value AND s.fold = t.fold
UNION ALL
SELECT 'test' AS split, '{name}' AS source, g.target, v.customer_id,
  round(coalesce((m.ty + g.gm * 20.0::DOUBLE) / (m.tn + 20.0::DOUBLE), g.gm), 9) AS score
FROM {name}_vals v CROSS JOIN {name}_gm g
LEFT JOIN (SELECT target, value, sum(sy) AS ty, sum(n) AS tn FROM {name}_stats GROUP BY ALL) m
  ON m.target = g.target AND m.value = v.value
WHERE v.is_test = 1""")


_te_source("s_te_seg", "cat_feature_segment")
_te_source("s_te_nation", "cat_feature_nation")


def _minmax_source(name: str, expr: str, targets) -> None:
    tv = ", ".join(f"('{t}')" for t in targets)
    block(name, ("mart",), f"""
SELECT CASE WHEN m.is_test = 1 THEN 'test' ELSE 'oof' END AS split, '{name}' AS source,
  tg.target, m.customer_id, round((m.x - mm.mn) / nullif(mm.mx - mm.mn, 0), 9) AS score
FROM (SELECT customer_id, is_test, ({expr})::DOUBLE AS x FROM mart) m
CROSS JOIN (SELECT min(({expr})::DOUBLE) AS mn, max(({expr})::DOUBLE) AS mx FROM mart) mm
CROSS JOIN (VALUES {tv}) tg(target)""")


_minmax_source("s_bal", "num_feature_acctbal", TARGETS)
_minmax_source("s_spec", f"coalesce({xi('extra_extendedprice_sum')}, 0)", SPEC_TARGETS)
block("s_dup", ("s_bal",), "SELECT split, 's_dup' AS source, target, customer_id, score FROM s_bal")
block("preds", tuple(SOURCE_ORDER), "\nUNION ALL\n".join(
    f"SELECT * FROM {s}" for s in SOURCE_ORDER))
block("manifest", (), "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', {i})" for i, s in enumerate(SOURCE_ORDER)) + ") t(source, position)")
block("oof_scored", ("preds", "labels"), """SELECT p.source, p.target, p.customer_id, p.score, l.y
FROM preds p JOIN labels l USING (target, customer_id) WHERE p.split = 'oof'""")


def auc_sql(scored: str, group: str, score: str = "score", label: str = "y",
            digits: int | None = 9) -> str:
    """Exact AUC per group over a relation ``scored`` (group cols comma-separated)."""
    g = group
    rs = f"round({score}::DOUBLE, {digits})" if digits is not None else f"{score}::DOUBLE"
    return f"""(SELECT {g}, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg,
  round(sum(p * (below + n * 0.5::DOUBLE)) / nullif((sum(p) * sum(n))::DOUBLE, 0), 12) AS auc
FROM (SELECT {g}, p, n, coalesce(sum(n) OVER (PARTITION BY {g} ORDER BY s
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {g}, {rs} AS s, sum({label})::BIGINT AS p,
              (count(*) - sum({label}))::BIGINT AS n
            FROM {scored} GROUP BY {g}, {rs}))
GROUP BY {g})"""


block("src_auc", ("oof_scored",), "SELECT * FROM " + auc_sql("oof_scored", "target, source"))
