"""The entity mart: one row per customer (= order) with features and labels.

The driver's tables stand in for the contest data:

* entity ``customer_id`` = ``o_orderkey``; ``is_test`` = hash split (1 in 5);
* main numeric features ``num_feature_*`` and categorical ``cat_feature_*``;
* an *extra* block of per-order line aggregates kept as ``extra ARRAY<DOUBLE>``
  plus a dictionary ``(pos, feature)``. Wide blocks are never carried as
  thousands of scalar columns: per-row statistics are higher-order functions on
  the array, per-feature statistics are ``posexplode`` + ``groupBy(pos)``;
* labels are long ``(customer_id, target, y)`` for train rows.

Orders without line items keep null extras (the null paths of every operator).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackrank.functions import h
from stackrank.sources.tables import read_table

ID = "customer_id"
SPLIT_SALT = "split"
N_SPLIT = 5

# The extra block (measure x statistic, then flag counts), in order.
EXTRA_MEASURES = ("quantity", "extendedprice", "discount", "tax")
EXTRA_STATS = ("sum", "max", "min", "avg")
EXTRA_FLAGS = (("rf_a", "l_returnflag", "A"), ("rf_n", "l_returnflag", "N"),
               ("rf_r", "l_returnflag", "R"), ("ls_f", "l_linestatus", "F"),
               ("ls_o", "l_linestatus", "O"))
EXTRA_FEATURES = tuple([f"extra_{m}_{s}" for m in EXTRA_MEASURES for s in EXTRA_STATS]
                       + [f"extra_{name}" for name, _, _ in EXTRA_FLAGS])

NUM_FEATURES = ("num_feature_totalprice", "num_feature_acctbal")
CAT_FEATURES = ("cat_feature_priority", "cat_feature_status", "cat_feature_segment",
                "cat_feature_nation")

# The seven targets and their definitions over the mart.
TARGETS = ("target_1_1", "target_1_2", "target_2_1", "target_2_2", "target_3_1",
           "target_3_2", "target_9_9")


def _target_exprs(m: DataFrame) -> dict[str, Column]:
    prio, status, price = F.col("cat_feature_priority"), F.col("cat_feature_status"), F.col(
        "num_feature_totalprice")
    rf_r = F.col("extra")[EXTRA_FEATURES.index("extra_rf_r")]
    qty = F.col("extra")[EXTRA_FEATURES.index("extra_quantity_sum")]
    return {
        "target_1_1": F.coalesce(rf_r, F.lit(0.0)) > 0,
        "target_1_2": F.coalesce(qty, F.lit(0.0)) > 200,
        "target_2_1": prio == "1-URGENT",
        "target_2_2": (status == "F") & prio.startswith("1"),
        "target_3_1": price > 490000,
        "target_3_2": (prio == "1-URGENT") & (price > 450000) & (status == "P"),
        "target_9_9": F.lit(False),
    }


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order aggregates of lineitem: one partial aggregation keyed by order."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     "l_returnflag", "l_linestatus"])
    fns = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}
    aggs = [F.round(fns[s](F.col(f"l_{m}")).cast("double"), 6).alias(f"extra_{m}_{s}")
            for m in EXTRA_MEASURES for s in EXTRA_STATS]
    aggs += [F.count_if(F.col(c) == v).cast("double").alias(f"extra_{name}")
             for name, c, v in EXTRA_FLAGS]
    return li.groupBy(F.col("l_orderkey").alias(ID)).agg(*aggs)


def build_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, is_test, num_feature_*, cat_feature_*, extra ARRAY<DOUBLE>."""
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                         "o_orderpriority"])
    cust = read_table(spark, sf_dir, "customer",
                      ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    lines = line_features(spark, sf_dir)
    main = orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")
    m = main.join(lines, main.o_orderkey == lines[ID], "left")
    return m.select(
        F.col("o_orderkey").alias(ID),
        (h(SPLIT_SALT, "o_orderkey") % N_SPLIT == N_SPLIT - 1).cast("int").alias("is_test"),
        F.col("o_totalprice").cast("double").alias("num_feature_totalprice"),
        F.col("c_acctbal").cast("double").alias("num_feature_acctbal"),
        F.col("o_orderpriority").alias("cat_feature_priority"),
        F.col("o_orderstatus").alias("cat_feature_status"),
        F.col("c_mktsegment").alias("cat_feature_segment"),
        F.col("c_nationkey").alias("cat_feature_nation"),
        F.array(*[F.col(f) for f in EXTRA_FEATURES]).alias("extra"),
    )


def feature_dictionary(spark: SparkSession) -> DataFrame:
    """(pos INT, feature STRING) for the extra block; tiny and fixed-size."""
    return spark.createDataFrame([(i, f) for i, f in enumerate(EXTRA_FEATURES)],
                                 "pos INT, feature STRING")


def extra_long(mart: DataFrame) -> DataFrame:
    """(customer_id, is_test, pos, value) — nulls kept (posexplode keeps them)."""
    return mart.select(ID, "is_test", F.posexplode("extra").alias("pos", "value"))


def labels_wide(mart: DataFrame) -> DataFrame:
    """Train rows with one 0/1 INT column per target (the contest's target table)."""
    ex = _target_exprs(mart)
    return mart.filter(F.col("is_test") == 0).select(
        ID, *[ex[t].cast("int").alias(t) for t in TARGETS])


def labels_array(mart: DataFrame) -> DataFrame:
    """(customer_id, ys ARRAY<INT>) for train rows, the labels in the order of ``TARGETS``."""
    ex = _target_exprs(mart)
    return mart.filter(F.col("is_test") == 0).select(
        ID, F.array(*[ex[t].cast("int") for t in TARGETS]).alias("ys"))


def labels_long(packed: DataFrame) -> DataFrame:
    """(customer_id, target, y INT) of ``labels_array``: a projection that keeps the layout by
    customer, so joins on the customer need no shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col("ys")[i].alias("y"))
                               for i, t in enumerate(TARGETS)]))
    return packed.select(ID, each.alias("_e")).select(ID, "_e.target", "_e.y")
