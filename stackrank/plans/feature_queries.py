"""Feature queries: profiles, selection, row statistics, encoders, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackrank.functions.hashing import sql_h
from stackrank.operators import encode as EN
from stackrank.operators import profile as PR
from stackrank.operators import sampling as SA
from stackrank.operators.metrics import any_target
from stackrank.operators.rowstats import row_stats, row_zeros
from stackrank.plans.catalog import query
from stackrank.plans.sqlblocks import block, with_ctes
from stackrank.sources import mart as MT
from stackrank.sources.context import context, materialize

# Parameters of the selection queries.
VAR_TOP_K = 10
FIRST_K = 8
BLOCK_START, BLOCK_SIZE = 3, 8
DROP_LIST = ("extra_discount_avg", "extra_rf_n")
LOWEST_N = 5
MI_K, MI_CAP, MI_FALLBACK = 5, 8, 64
BASE_KEEP_N = 40
IMP_UNIVERSAL, IMP_SPECIAL, IMP_TOTAL = 6, 2, 10
SAMPLE_N = 1000
STRAT_ROWS = 2000
CAT_COLS = MT.CAT_FEATURES


def _dictionary(spark):
    return MT.feature_dictionary(spark)


def _drop_df(spark):
    return spark.createDataFrame([(f,) for f in DROP_LIST], "feature STRING")


# -- SQL blocks for this module --------------------------------------------------------
block("var_rank", ("extra_long", "dict"), """SELECT row_number() OVER (ORDER BY v.variance DESC NULLS LAST,
    d.feature)::INTEGER AS rank, v.pos, d.feature, v.variance::FLOAT AS variance
FROM (SELECT pos, var_samp(coalesce(value, 0)) AS variance FROM extra_long WHERE is_test = 0
      GROUP BY pos) v JOIN dict d USING (pos)""")
block("distinct_counts", ("extra_long", "dict"), """SELECT c.pos, d.feature, c.n_unique FROM (
  SELECT pos, count(DISTINCT value)::BIGINT AS n_unique FROM extra_long GROUP BY pos) c
JOIN dict d USING (pos)""")
block("pseudo", ("distinct_counts",),
      "SELECT * FROM distinct_counts WHERE n_unique BETWEEN 2 AND 50")
# -- E7: the sample, jittered numbers, neighbours within the class, how many rows are nearer
MI_STATS = ("row_extra_mean", "row_extra_min", "row_extra_max", "row_extra_sum",
            "row_extra_null_count", "row_extra_zero_count")
MI_NUMBERS = (*MT.EXTRA_FEATURES, *MT.NUM_FEATURES, *MI_STATS)
MI_FEATURES = (*MT.EXTRA_FEATURES, *CAT_COLS, *MT.NUM_FEATURES, *MI_STATS)
_stat_sql = ("round(list_avg(extra), 6)", "list_min(extra)", "list_max(extra)",
             "round(coalesce(list_sum(extra), 0), 6)",
             "len(list_filter(extra, lambda x: x IS NULL))::DOUBLE",
             "len(list_filter(extra, lambda x: coalesce(x, 0) = 0))::DOUBLE")
block("mi_sample", ("mart",), f"""SELECT * FROM mart WHERE is_test = 0
QUALIFY row_number() OVER (ORDER BY {sql_h('sample42', 'customer_id')}, customer_id) <= {PR.MI_ROWS}""")
block("mi_x", ("mi_sample",), f"""SELECT customer_id, feature,
  v + (1e-10::DOUBLE * greatest(1.0::DOUBLE, max(abs(v)) OVER (PARTITION BY feature)))
      * ({sql_h('mi', 'feature', 'customer_id')} / 4294967296.0::DOUBLE) AS x
FROM (SELECT customer_id, unnest([{', '.join(f"'{f}'" for f in MI_NUMBERS)}]) AS feature,
             coalesce(unnest(list_concat(extra, [{', '.join(MT.NUM_FEATURES)}, {', '.join(_stat_sql)}])),
                      0.0::DOUBLE) AS v
      FROM mi_sample)""")
block("mi_rows", ("mi_x", "labels"), f"""SELECT *,
  list_sort(list_filter([{', '.join(f'x - lag(x, {j}) OVER w, lead(x, {j}) OVER w - x'
                                    for j in range(1, PR.MI_NEIGHBOURS + 1))}],
                        lambda z: z IS NOT NULL))[k] AS r
FROM (SELECT v.feature, l.target, l.y, v.customer_id, v.x,
        count(*) OVER (PARTITION BY v.feature, l.target, l.y) AS nc,
        least({PR.MI_NEIGHBOURS}, count(*) OVER (PARTITION BY v.feature, l.target, l.y) - 1) AS k
      FROM mi_x v JOIN labels l USING (customer_id))
WHERE nc > 1
WINDOW w AS (PARTITION BY feature, target, y ORDER BY x)""")
block("mi_near", ("mi_rows",), """SELECT feature, target, customer_id,
  sum(CASE WHEN kind = 0 THEN below ELSE -below END) AS m
FROM (SELECT feature, target, customer_id, kind, count(*) FILTER (WHERE kind = 1) OVER (
        PARTITION BY feature, target ORDER BY v, kind
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below
      FROM (SELECT feature, target, customer_id, x + r AS v, 0 AS kind FROM mi_rows
            UNION ALL SELECT feature, target, customer_id, x, 1 FROM mi_rows
            UNION ALL SELECT feature, target, customer_id, x - r, 2 FROM mi_rows))
WHERE kind <> 1 GROUP BY ALL""")
block("psi", ("mi_sample",), """SELECT n, sum(CASE WHEN n = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (n - 1) END)
  OVER (ORDER BY n) - 0.5772156649015329::DOUBLE AS psi
FROM range(1, (SELECT count(*) FROM mi_sample) + 1) t(n)""")
block("mi_num", ("mi_rows", "mi_near", "psi"), """SELECT target, feature,
  greatest(0.0::DOUBLE, avg(n.psi + k.psi - c.psi - m.psi)) AS mi
FROM (SELECT r.target, r.feature, r.k, r.nc, greatest(e.m, 1) AS m,
        count(*) OVER (PARTITION BY r.target, r.feature) AS n
      FROM mi_rows r JOIN mi_near e USING (feature, target, customer_id)) x
JOIN psi n ON n.n = x.n JOIN psi k ON k.n = x.k JOIN psi c ON c.n = x.nc JOIN psi m ON m.n = x.m
GROUP BY target, feature""")
_cat_bins = "\nUNION ALL\n".join(
    f"SELECT customer_id, '{c}' AS feature, coalesce({c}::VARCHAR, '__MISSING__') AS bin "
    f"FROM mi_sample" for c in CAT_COLS)
block("bins", ("mi_sample",), _cat_bins)
block("mi_labels", ("labels", "mi_sample"),
      "SELECT * FROM labels SEMI JOIN mi_sample USING (customer_id)")
block("mi_cat", ("bins", "mi_labels"), """SELECT c.target, c.feature,
  sum(CASE WHEN c.nb1 > 0 THEN c.nb1 / c.N * ln(c.nb1 * c.N / (c.nb * c.N1)) ELSE 0 END
    + CASE WHEN c.nb - c.nb1 > 0 THEN (c.nb - c.nb1) / c.N
           * ln((c.nb - c.nb1) * c.N / (c.nb * (c.N - c.N1))) ELSE 0 END) AS mi
FROM (SELECT b.feature, b.bin, b.nb::DOUBLE AS nb, t.target, t.N::DOUBLE AS N, t.N1::DOUBLE AS N1,
        coalesce(p.nb1, 0)::DOUBLE AS nb1
      FROM (SELECT feature, bin, count(*) AS nb FROM bins GROUP BY ALL) b
      CROSS JOIN (SELECT target, count(*) AS N, sum(y) AS N1 FROM mi_labels GROUP BY target) t
      LEFT JOIN (SELECT l.target, b.feature, b.bin, count(*) AS nb1
                 FROM mi_labels l JOIN bins b USING (customer_id) WHERE l.y = 1 GROUP BY ALL) p
        ON p.target = t.target AND p.feature = b.feature AND p.bin = b.bin) c
GROUP BY c.target, c.feature""")
block("mi", ("mi_num", "mi_cat", "mi_labels"), f"""SELECT m.target, m.feature,
  round(m.mi, {PR.MI_DIGITS}) AS mi, t.N1, t.N
FROM (SELECT target, feature, mi FROM mi_num UNION ALL SELECT target, feature, mi FROM mi_cat) m
JOIN (SELECT target, count(*)::DOUBLE AS N, sum(y)::DOUBLE AS N1 FROM mi_labels GROUP BY target) t
  USING (target)""")
block("mi_pool", (), "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {i})" for i, c in enumerate(MI_FEATURES)) + ") t(feature, position)")
block("mi_top", ("mi", "mi_pool"), f"""SELECT target, rank, feature FROM (
  SELECT m.target, m.feature, row_number() OVER (PARTITION BY m.target ORDER BY
      CASE WHEN m.N1 = 0 OR m.N1 = m.N THEN 0.0 ELSE -m.mi END,
      CASE WHEN m.N1 = 0 OR m.N1 = m.N THEN p.position ELSE 0 END, m.feature)::INTEGER AS rank
  FROM mi m JOIN mi_pool p USING (feature)) WHERE rank <= {MI_K}""")


def _mi(ctx):
    """(target, feature, mi, N1, N) on a sample of the train rows."""
    train = SA.sample_random(ctx.mart.filter("is_test = 0"), PR.MI_ROWS)
    sample = materialize(ctx.spark, (*ctx._key, "mi_sample"), lambda: train)
    labels = ctx.labels.join(sample.select("customer_id"), "customer_id", "left_semi")
    stats = row_stats(sample)
    values = F.concat("extra", F.array(*[F.col(c).cast("double") for c in MT.NUM_FEATURES]),
                      F.array(*[F.round(c, 6) if c in ("row_extra_mean", "row_extra_sum")
                                else F.col(c) for c in MI_STATS]))
    num = PR.numeric_information(PR.numeric_values(stats, list(MI_NUMBERS), values), labels)
    cat = PR.category_information(PR.category_values(sample, CAT_COLS), labels)
    mi = materialize(ctx.spark, (*ctx._key, "mi"), lambda: num.unionByName(cat))
    return mi.withColumn("mi", F.round("mi", PR.MI_DIGITS)).join(
        F.broadcast(PR.class_sizes(labels)), "target")                # one row per target


def _mi_pool(spark):
    return spark.createDataFrame([(f, i) for i, f in enumerate(MI_FEATURES)],
                                 "feature STRING, position INT")


# -- A3 / A15 ---------------------------------------------------------------------------------
@query("schema_profile", with_ctes(
    "SELECT feature, role, n_train, n_test FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{'num' if c.startswith('num') else 'cat'}' AS role, "
        f"count({c}) FILTER (WHERE is_test = 0)::BIGINT AS n_train, "
        f"count({c}) FILTER (WHERE is_test = 1)::BIGINT AS n_test FROM mart"
        for c in MT.NUM_FEATURES + MT.CAT_FEATURES)
    + " UNION ALL SELECT d.feature, 'extra' AS role, "
      "count(e.value) FILTER (WHERE e.is_test = 0)::BIGINT, "
      "count(e.value) FILTER (WHERE e.is_test = 1)::BIGINT "
      "FROM extra_long e JOIN dict d USING (pos) GROUP BY d.feature)", "mart", "extra_long", "dict"))
def q_schema_profile(spark, sf_dir):
    """Roles discovered by name prefix from ``df.schema`` (no job), non-null counts
    per split from the data (one aggregation for the scalar columns, one
    ``groupBy(pos)`` for the extra block)."""
    ctx = context(spark, sf_dir)
    mart = ctx.mart
    roles = [(c, "num") for c in mart.columns if c.startswith("num_feature")]
    roles += [(c, "cat") for c in mart.columns if c.startswith("cat_feature")]
    aggs = []
    for c, _ in roles:
        aggs += [F.count(F.when(F.col("is_test") == 0, F.col(c))).alias(f"{c}__0"),
                 F.count(F.when(F.col("is_test") == 1, F.col(c))).alias(f"{c}__1")]
    wide = mart.agg(*aggs)
    scalar = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(r).alias("role"),
                 F.col(f"{c}__0").alias("n_train"), F.col(f"{c}__1").alias("n_test"))
        for c, r in roles])).alias("s")).select("s.*")
    extra = (ctx.extra_long.groupBy("pos")
             .agg(F.count(F.when(F.col("is_test") == 0, F.col("value"))).alias("n_train"),
                  F.count(F.when(F.col("is_test") == 1, F.col("value"))).alias("n_test"))
             .join(_dictionary(spark), "pos")
             .select("feature", F.lit("extra").alias("role"), "n_train", "n_test"))
    return scalar.unionByName(extra).select(
        "feature", "role", F.col("n_train").cast("bigint").alias("n_train"),
        F.col("n_test").cast("bigint").alias("n_test"))


# -- E1-E3 ------------------------------------------------------------------------------------
@query("variance_topk", with_ctes(f"SELECT * FROM var_rank WHERE rank <= {VAR_TOP_K}", "var_rank"))
def q_variance_topk(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return PR.take_slice(PR.variance_ranking(ctx.extra_long, _dictionary(spark)), top_k=VAR_TOP_K)


@query("first_k", with_ctes(
    f"SELECT (d.pos + 1)::INTEGER AS rank, d.feature FROM (SELECT DISTINCT pos FROM extra_long) e "
    f"JOIN dict d USING (pos) WHERE d.pos < {FIRST_K}", "extra_long", "dict"))
def q_first_k(spark, sf_dir):
    """The first k features in file order (features discovered from the data)."""
    ctx = context(spark, sf_dir)
    present = ctx.extra_long.select("pos").distinct().join(_dictionary(spark), "pos")
    return present.filter(F.col("pos") < FIRST_K).select(
        (F.col("pos") + 1).cast("int").alias("rank"), "feature")


@query("rank_block", with_ctes(
    f"SELECT * FROM var_rank WHERE rank > {BLOCK_START} AND rank <= {BLOCK_START + BLOCK_SIZE} "
    "AND feature NOT IN (" + ", ".join(f"'{f}'" for f in DROP_LIST) + ")", "var_rank"))
def q_rank_block(spark, sf_dir):
    ctx = context(spark, sf_dir)
    ranked = PR.variance_ranking(ctx.extra_long, _dictionary(spark))
    return PR.take_slice(ranked, 0, BLOCK_START, BLOCK_SIZE, drop=_drop_df(spark))


# -- E4-E6 -------------------------------------------------------------------------------------
@query("pseudo_categorical", with_ctes("SELECT feature, n_unique FROM pseudo", "pseudo"))
def q_pseudo_categorical(spark, sf_dir):
    ctx = context(spark, sf_dir)
    counts = PR.few_distinct(ctx.mart, _dictionary(spark))
    return PR.pseudo_categorical(counts).select("feature", "n_unique")


@query("pseudo_cat_lowest", with_ctes(
    f"SELECT * FROM (SELECT feature, n_unique, row_number() OVER (ORDER BY n_unique, feature)"
    f"::INTEGER AS rank FROM pseudo) WHERE rank <= {LOWEST_N}", "pseudo"))
def q_pseudo_cat_lowest(spark, sf_dir):
    ctx = context(spark, sf_dir)
    pseudo = PR.pseudo_categorical(PR.few_distinct(ctx.mart, _dictionary(spark)))
    return PR.lowest_unique(pseudo, LOWEST_N).select("feature", "n_unique", "rank")


@query("cat_list", with_ctes(
    "SELECT feature, (row_number() OVER (ORDER BY l, p) - 1)::INTEGER AS position FROM ("
    "SELECT feature, min(l) AS l, min_by(p, l * 1000000 + p) AS p FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, 0 AS l, {i} AS p" for i, c in enumerate(CAT_COLS))
    + f" UNION ALL SELECT p.feature, 1 AS l, (row_number() OVER (ORDER BY p.feature) - 1) AS p "
      f"FROM pseudo p JOIN (SELECT feature FROM var_rank WHERE rank <= {VAR_TOP_K}) v USING (feature)"
    + ") GROUP BY feature)", "pseudo", "var_rank"))
def q_cat_list(spark, sf_dir):
    """E6 + J2 + J4: category list = base categoricals, then the pseudo-categoricals
    (by name) that are in the selected feature set, de-duplicated in order."""
    ctx = context(spark, sf_dir)
    dic = _dictionary(spark)
    pseudo = PR.pseudo_categorical(PR.few_distinct(ctx.mart, dic))
    selected = PR.take_slice(PR.variance_ranking(ctx.extra_long, dic), top_k=VAR_TOP_K)
    in_set = pseudo.join(selected.select("feature"), "feature", "left_semi")
    from pyspark.sql import Window
    ext = in_set.select("feature", (F.row_number().over(Window.orderBy("feature")) - 1)
                        .alias("position"))
    base = spark.createDataFrame([(c, i) for i, c in enumerate(CAT_COLS)],
                                 "feature STRING, position INT")
    return PR.ordered_union(base, ext)


# -- E7-E9, E11 --------------------------------------------------------------------------------
@query("mi_topk", with_ctes("SELECT * FROM mi_top", "mi_top"))
def q_mi_topk(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return PR.mi_topk(_mi(ctx), _mi_pool(spark), MI_K)


_union_ctes = [
    ("ranked", "SELECT feature, row_number() OVER (ORDER BY count(*) DESC, avg(rank - 1), feature) "
               "AS urank FROM mi_top GROUP BY feature"),
    ("kept", f"SELECT t.target, t.feature, t.rank FROM mi_top t WHERE t.feature IN "
             f"(SELECT feature FROM ranked WHERE urank <= {MI_CAP})"),
    ("fallback", f"SELECT e.target, r.feature, r.urank AS rank FROM (SELECT DISTINCT target FROM "
                 f"mi_top EXCEPT SELECT DISTINCT target FROM kept) e CROSS JOIN ranked r "
                 f"WHERE r.urank <= {MI_FALLBACK}"),
    ("sel", "SELECT * FROM kept UNION ALL SELECT * FROM fallback"),
    ("base", "SELECT feature, position FROM mi_pool WHERE feature LIKE 'cat_feature%' "
             "OR feature LIKE 'num_feature%'"),
    ("merged", f"""SELECT target, feature, 0 AS l, rank AS p FROM sel
UNION ALL SELECT t.target, p.feature, 1 AS l, p.position AS p
  FROM (SELECT DISTINCT target FROM mi_top) t CROSS JOIN mi_pool p WHERE p.feature LIKE 'row_extra_%'
UNION ALL SELECT t.target, b.feature, 2 AS l, b.position AS p
  FROM (SELECT DISTINCT target FROM mi_top) t CROSS JOIN
       (SELECT * FROM base QUALIFY row_number() OVER (ORDER BY position) <= {BASE_KEEP_N}) b"""),
]


@query("mi_union_cap", with_ctes(
    "SELECT target, feature, (row_number() OVER (PARTITION BY target ORDER BY l, p) - 1)::INTEGER "
    "AS position FROM (SELECT target, feature, min(l) AS l, arg_min(p, l * 1000000 + p) AS p "
    "FROM merged GROUP BY target, feature)", "mi_top", "mi_pool", extra=_union_ctes))
def q_mi_union_cap(spark, sf_dir):
    """E8 + E9: union cap over the per-target MI selections, fallback for targets
    left empty, then always-keep and base features appended (order kept)."""
    ctx = context(spark, sf_dir)
    pool = _mi_pool(spark)
    top = PR.mi_topk(_mi(ctx), pool, MI_K)
    sel = PR.union_cap(top, MI_CAP, MI_FALLBACK)
    targets = top.select("target").distinct()
    always = targets.crossJoin(pool.filter(F.col("feature").startswith("row_extra_")))
    base = pool.filter(F.col("feature").startswith("cat_feature")
                       | F.col("feature").startswith("num_feature"))
    from pyspark.sql import Window
    base = base.withColumn("_r", F.row_number().over(Window.orderBy("position"))).filter(
        F.col("_r") <= BASE_KEEP_N).drop("_r")
    merged = (sel.select("target", "feature", F.lit(0).alias("l"), F.col("rank").alias("p"))
              .unionByName(always.select("target", "feature", F.lit(1).alias("l"),
                                         F.col("position").alias("p")))
              .unionByName(targets.crossJoin(base).select("target", "feature", F.lit(2).alias("l"),
                                                          F.col("position").alias("p"))))
    first = merged.groupBy("target", "feature").agg(F.min(F.struct("l", "p")).alias("k"))
    w = Window.partitionBy("target").orderBy("k")
    return first.select("target", "feature",
                        (F.row_number().over(w) - 1).cast("int").alias("position"))


@query("importance_union", with_ctes(f"""
SELECT feature, (row_number() OVER (ORDER BY best, feature) - 1)::INTEGER AS position FROM (
  SELECT feature, min(r) AS best FROM (
    SELECT feature, row_number() OVER (ORDER BY avg(mi) DESC, feature) AS r FROM mi GROUP BY feature
    QUALIFY r <= {IMP_UNIVERSAL}
    UNION ALL
    SELECT feature, r FROM (SELECT feature, row_number() OVER (PARTITION BY target
        ORDER BY mi DESC, feature) AS r FROM mi) WHERE r <= {IMP_SPECIAL})
  GROUP BY feature)
QUALIFY position < {IMP_TOTAL}""", "mi"))
def q_importance_union(spark, sf_dir):
    """Universal features (top by mean importance) union per-target specialists,
    ordered by best rank then name, first n. Importance = information per target."""
    from pyspark.sql import Window
    from stackrank.sources import reports as RS
    mi = _mi(context(spark, sf_dir)).select("target", "feature", "mi")
    # The importance report goes through a CSV with a header and an index
    # column and is read back with an explicit schema.
    path = RS.scratch_path(spark, "importance-csv")
    RS.write_csv_report(mi.withColumn("idx", F.concat_ws("|", "target", "feature")), path, "idx")
    mi = RS.read_csv_report(spark, path, "idx STRING, feature STRING, mi DOUBLE, target STRING")
    uni = (mi.groupBy("feature").agg(F.avg("mi").alias("m"))
             .withColumn("r", F.row_number().over(Window.orderBy(F.col("m").desc(), "feature")))
             .filter(F.col("r") <= IMP_UNIVERSAL).select("feature", "r"))
    spec = (mi.withColumn("r", F.row_number().over(
        Window.partitionBy("target").orderBy(F.col("mi").desc(), "feature")))
        .filter(F.col("r") <= IMP_SPECIAL).select("feature", "r"))
    best = uni.unionByName(spec).groupBy("feature").agg(F.min("r").alias("best"))
    return (best.withColumn("position", (F.row_number().over(
        Window.orderBy("best", "feature")) - 1).cast("int"))
        .filter(F.col("position") < IMP_TOTAL).select("feature", "position"))


# -- D1 / D2 -----------------------------------------------------------------------------------
@query("row_stats", with_ctes("""SELECT customer_id,
  round(list_avg(extra), 6) AS row_extra_mean, list_min(extra) AS row_extra_min,
  list_max(extra) AS row_extra_max, round(coalesce(list_sum(extra), 0), 6) AS row_extra_sum,
  len(list_filter(extra, lambda x: x IS NULL))::DOUBLE AS row_extra_null_count,
  len(list_filter(extra, lambda x: coalesce(x, 0) = 0))::DOUBLE AS row_extra_zero_count,
  len(list_filter(extra, lambda x: x IS NULL)) / len(extra) AS row_extra_null_share,
  len(list_filter(extra, lambda x: coalesce(x, 0) = 0)) / len(extra) AS row_extra_zero_share
FROM mart""", "mart"))
def q_row_stats(spark, sf_dir):
    st = row_stats(context(spark, sf_dir).mart.select("customer_id", "extra")).drop("extra")
    return (st.withColumn("row_extra_mean", F.round("row_extra_mean", 6))
              .withColumn("row_extra_sum", F.round("row_extra_sum", 6)))


@query("row_zeros", with_ctes("""SELECT customer_id, round(list_avg(extra), 6) AS row_mean,
  len(list_filter(extra, lambda x: x = 0))::INTEGER AS row_zeros, list_max(extra) AS row_max
FROM mart""", "mart"))
def q_row_zeros(spark, sf_dir):
    st = row_zeros(context(spark, sf_dir).mart.select("customer_id", "extra")).drop("extra")
    return st.withColumn("row_mean", F.round("row_mean", 6))


# -- C2 / C3 / C4 / D3 ---------------------------------------------------------------------------
# (SQL text, Spark column builder) per coerced column; builders run only inside a session.
_coerce_cols = {"priority_code": ("substr(cat_feature_priority, 1, 1)",
                                  lambda: F.substring("cat_feature_priority", 1, 1)),
                "status": ("cat_feature_status", lambda: F.col("cat_feature_status")),
                "nation": ("cat_feature_nation::VARCHAR",
                           lambda: F.col("cat_feature_nation").cast("string"))}


@query("numeric_coerce", with_ctes(" UNION ALL ".join(
    f"SELECT customer_id, '{k}' AS feature, {sql} AS value_text, "
    f"TRY_CAST({sql} AS FLOAT) AS value_num FROM mart" for k, (sql, _) in _coerce_cols.items()),
    "mart"))
def q_numeric_coerce(spark, sf_dir):
    mart = context(spark, sf_dir).mart
    parts = [mart.select("customer_id", F.lit(k).alias("feature"), c().alias("value_text"))
             for k, (_, c) in _coerce_cols.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value_num", EN.numeric_coerce(F.col("value_text")))


_code_src = {"cat_feature_priority": "cat_feature_priority",
             "cat_feature_status": "nullif(cat_feature_status, 'O')",
             "cat_feature_segment": "cat_feature_segment",
             "cat_feature_nation": "cat_feature_nation::VARCHAR"}


@query("cat_codes", with_ctes("""SELECT v.customer_id, v.feature, c.code FROM v JOIN (
  SELECT feature, value_text, (row_number() OVER (PARTITION BY feature ORDER BY min(customer_id),
      value_text) - 1)::INTEGER AS code FROM v GROUP BY feature, value_text) c USING (feature, value_text)""",
    "mart", extra=[("v", " UNION ALL ".join(
        f"SELECT customer_id, '{f}' AS feature, coalesce({e}, '__MISSING__') AS value_text FROM mart"
        for f, e in _code_src.items()))]))
def q_cat_codes(spark, sf_dir):
    """D3 + C3: joint train+test codes; the status column has its 'O' values nulled
    to exercise the missing-value path."""
    mart = context(spark, sf_dir).mart
    cols = {"cat_feature_priority": F.col("cat_feature_priority"),
            "cat_feature_status": F.when(F.col("cat_feature_status") != "O",
                                         F.col("cat_feature_status")),
            "cat_feature_segment": F.col("cat_feature_segment"),
            "cat_feature_nation": F.col("cat_feature_nation").cast("string")}
    vals = mart.select("customer_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("feature"), c.alias("value")) for k, c in cols.items()]))
        .alias("s")).select("customer_id", "s.feature", "s.value")
    return EN.category_codes(vals).select("customer_id", "feature", "code")


@query("quantize", with_ctes(
    "SELECT customer_id, round_even(num_feature_totalprice, 0) AS num_feature_totalprice_q0, "
    "round_even(num_feature_acctbal, 0) AS num_feature_acctbal_q0 FROM mart", "mart"))
def q_quantize(spark, sf_dir):
    mart = context(spark, sf_dir).mart.select("customer_id", *MT.NUM_FEATURES)
    return EN.quantize(mart, MT.NUM_FEATURES, [0]).drop(*MT.NUM_FEATURES)


# -- D8 / D9 ----------------------------------------------------------------------------------------
@query("impute_median", with_ctes(
    "SELECT e.customer_id, e.pos, round(coalesce(e.value, m.med), 6) AS value FROM extra_long e "
    "JOIN (SELECT pos, median(value) AS med FROM extra_long WHERE is_test = 0 GROUP BY pos) m USING (pos)",
    "extra_long"))
def q_impute_median(spark, sf_dir):
    long = context(spark, sf_dir).extra_long
    return EN.median_impute_long(long.drop("is_test"), fit=long.filter("is_test = 0")).withColumn(
        "value", F.round("value", 6))


@query("standardize", with_ctes(
    "SELECT e.customer_id, e.pos, round((e.value - s.mu) / CASE WHEN s.sd IS NULL OR s.sd = 0 "
    "THEN 1.0 ELSE s.sd END, 6) AS value FROM extra_long e JOIN (SELECT pos, avg(value) AS mu, "
    "stddev_pop(value) AS sd FROM extra_long WHERE is_test = 0 GROUP BY pos) s USING (pos)",
    "extra_long"))
def q_standardize(spark, sf_dir):
    long = context(spark, sf_dir).extra_long
    # Mean and deviation are sums whose order varies between runs; 6 decimals keep
    # that noise (~1e-16) away from the rounding boundary.
    return EN.standardize_long(long.drop("is_test"), fit=long.filter("is_test = 0")).withColumn(
        "value", F.round("value", 6))


# -- D4 / D5 / D6 -----------------------------------------------------------------------------------
def _te_inputs(ctx):
    vals = ctx.mart.select("customer_id", "is_test", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
        for c in CAT_COLS])).alias("s")).select("customer_id", "is_test", "s.feature", "s.value")
    yany = any_target(ctx.labels).withColumnRenamed("y_any", "y")
    train = vals.filter("is_test = 0").drop("is_test").join(yany, "customer_id").join(
        ctx.folds, "customer_id")
    test = vals.filter("is_test = 1").drop("is_test")
    return train, test


_te_vals = " UNION ALL ".join(
    f"SELECT customer_id, is_test, '{c}' AS feature, {c}::VARCHAR AS value FROM mart" for c in CAT_COLS)
_te_common = [
    ("tv", _te_vals),
    ("yany", "SELECT customer_id, (sum(y) > 0)::INTEGER AS y FROM labels GROUP BY customer_id"),
    ("tr", "SELECT v.customer_id, v.feature, v.value, f.fold, a.y FROM tv v JOIN yany a USING "
           "(customer_id) JOIN folds f USING (customer_id) WHERE v.is_test = 0"),
    ("st", "SELECT feature, value, fold, sum(y)::DOUBLE AS sy, count(*)::DOUBLE AS n, "
           "sum(sum(y)) OVER (PARTITION BY feature, value)::DOUBLE AS ty, "
           "sum(count(*)) OVER (PARTITION BY feature, value)::DOUBLE AS tn FROM tr GROUP BY feature, value, fold"),
    ("gm", "SELECT feature, sum(sy) / sum(n) AS gm FROM st GROUP BY feature"),
]


@query("te_mapping", with_ctes(
    "SELECT t.feature, t.value, count(*)::BIGINT AS n, round((sum(t.y) + g.gm * 20.0::DOUBLE) "
    "/ (count(*) + 20.0::DOUBLE), 9) AS enc, round(g.gm, 9) AS gm FROM tr t JOIN "
    "(SELECT feature, avg(y::DOUBLE) AS gm FROM tr GROUP BY feature) g USING (feature) "
    "GROUP BY t.feature, t.value, g.gm", "mart", "labels", "folds", extra=_te_common[:3]))
def q_te_mapping(spark, sf_dir):
    train, _ = _te_inputs(context(spark, sf_dir))
    m = EN.smoothed_mapping(train, ["feature"])
    return m.select("feature", "value", "n", F.round("enc", 9).alias("enc"),
                    F.round("gm", 9).alias("gm"))


@query("te_oof", with_ctes(
    "SELECT t.customer_id, t.feature, round(coalesce(((s.ty - s.sy) + g.gm * 20.0::DOUBLE) / "
    "((s.tn - s.n) + 20.0::DOUBLE), g.gm), 9) AS enc FROM tr t JOIN gm g USING (feature) "
    "LEFT JOIN st s ON s.feature = t.feature AND s.value = t.value AND s.fold = t.fold",
    "mart", "labels", "folds", extra=_te_common))
def q_te_oof(spark, sf_dir):
    train, _ = _te_inputs(context(spark, sf_dir))
    tr, _ = EN.oof_target_encoding(train, None, ["feature"])
    return tr.select("customer_id", "feature", F.round("enc", 9).alias("enc"))


@query("te_test", with_ctes(
    "SELECT v.customer_id, v.feature, round(coalesce((m.ty + g.gm * 20.0::DOUBLE) / "
    "(m.tn + 20.0::DOUBLE), g.gm), 9) AS enc FROM tv v JOIN gm g USING (feature) LEFT JOIN "
    "(SELECT feature, value, sum(sy) AS ty, sum(n) AS tn FROM st GROUP BY ALL) m "
    "ON m.feature = v.feature AND m.value = v.value WHERE v.is_test = 1",
    "mart", "labels", "folds", extra=_te_common))
def q_te_test(spark, sf_dir):
    train, test = _te_inputs(context(spark, sf_dir))
    _, te = EN.oof_target_encoding(train, test, ["feature"])
    return te.select("customer_id", "feature", F.round("enc", 9).alias("enc"))


# -- J1 ------------------------------------------------------------------------------------------------
@query("train_test_union", with_ctes(
    "SELECT customer_id, is_test, cat_feature_nation::BIGINT AS cat_feature_nation, "
    "num_feature_totalprice FROM mart", "mart"))
def q_train_test_union(spark, sf_dir):
    """Train (nation INT) and test (nation widened to BIGINT) frames concatenated
    by name after casting to the wider type, with the split label."""
    mart = context(spark, sf_dir).mart
    train = mart.filter("is_test = 0").select("customer_id", "cat_feature_nation",
                                              "num_feature_totalprice")
    test = mart.filter("is_test = 1").select(
        "customer_id", F.col("cat_feature_nation").cast("bigint").alias("cat_feature_nation"),
        "num_feature_totalprice")
    t = train.withColumn("cat_feature_nation", F.col("cat_feature_nation").cast("bigint"))
    return (t.withColumn("is_test", F.lit(0)).unionByName(test.withColumn("is_test", F.lit(1)))
             .select("customer_id", "is_test", "cat_feature_nation", "num_feature_totalprice"))


# -- G5 / G6 / G7 / G9 --------------------------------------------------------------------------------
@query("sample_random", with_ctes(
    f"SELECT customer_id FROM mart WHERE is_test = 0 QUALIFY row_number() OVER (ORDER BY "
    f"{sql_h('sample42', 'customer_id')}, customer_id) <= {SAMPLE_N}", "mart"))
def q_sample_random(spark, sf_dir):
    """A repeatable n-row sample (instead of a head-limited scan)."""
    train = context(spark, sf_dir).mart.filter("is_test = 0").select("customer_id")
    return SA.sample_random(train, SAMPLE_N)


def _quota_sql(clamp_off: int) -> str:
    return f"""SELECT target, n_all, n_pos, n_all - n_pos AS n_neg,
  CASE WHEN n_all <= {STRAT_ROWS} THEN 4611686018427387904 WHEN n_pos = 0 OR n_pos = n_all THEN {STRAT_ROWS}
       ELSE greatest(1, least(round_even({STRAT_ROWS}.0::DOUBLE * (n_pos / n_all), 0)::BIGINT,
                              n_pos - {clamp_off})) END AS qp
FROM (SELECT target, count(*) AS n_all, sum(y) AS n_pos FROM labels GROUP BY target)"""


@query("sample_stratified", with_ctes(f"""
SELECT l.target, l.customer_id, l.y FROM (
  SELECT *, row_number() OVER (PARTITION BY target, y ORDER BY {sql_h('sample42', 'customer_id')},
     customer_id) - 1 AS pos FROM labels) l
JOIN (SELECT target, qp, CASE WHEN n_all <= {STRAT_ROWS} THEN 4611686018427387904
             WHEN n_pos = 0 OR n_pos = n_all THEN {STRAT_ROWS}
             ELSE greatest(1, least({STRAT_ROWS} - qp, n_neg - 1)) END AS qn FROM q) q USING (target)
WHERE l.pos < CASE WHEN l.y = 1 THEN q.qp ELSE q.qn END""", "labels", extra=[("q", _quota_sql(1))]))
def q_sample_stratified(spark, sf_dir):
    return SA.sample_stratified(context(spark, sf_dir).labels, STRAT_ROWS, clamp="n-1")


@query("bag_sample", with_ctes(f"""
SELECT target, fold, bag::INTEGER AS bag, customer_id, y FROM (
  SELECT t.*, b.bag, c.P, c.N,
    row_number() OVER (PARTITION BY t.target, t.fold, b.bag, t.y ORDER BY
      {sql_h('sample42', 'b.bag', 't.customer_id')}, t.customer_id) - 1 AS r,
    least(greatest(1, round_even(c.P * 20.0::DOUBLE, 0)::BIGINT), c.N) AS quota
  FROM tpart t CROSS JOIN range(0, 5) b(bag)
  JOIN (SELECT target, fold, sum(y) AS P, count(*) - sum(y) AS N FROM tpart GROUP BY ALL) c
    USING (target, fold))
WHERE P = 0 OR N = 0 OR y = 1 OR r < quota""", "labels", "folds", extra=[
    ("tpart", "SELECT l.target, k.fold, l.customer_id, l.y FROM labels l JOIN folds f USING "
              "(customer_id) CROSS JOIN (SELECT DISTINCT fold FROM folds) k WHERE f.fold <> k.fold")]))
def q_bag_sample(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return SA.bag_sample(ctx.labels, ctx.folds)


@query("shuffle_column", with_ctes(f"""
SELECT a.customer_id, a.pos, a.fold, a.value, b.value AS shuffled FROM
 (SELECT *, row_number() OVER (PARTITION BY pos, fold ORDER BY {sql_h('perm42b', 'customer_id')},
     customer_id) AS rb FROM t) b
JOIN (SELECT *, row_number() OVER (PARTITION BY pos, fold ORDER BY {sql_h('perm42a', 'customer_id')},
     customer_id) AS ra FROM t) a ON a.pos = b.pos AND a.fold = b.fold AND a.ra = b.rb""",
    "extra_long", "folds", extra=[("t", "SELECT e.customer_id, e.pos, f.fold, e.value FROM extra_long e "
                                        "JOIN folds f USING (customer_id)")]))
def q_shuffle_column(spark, sf_dir):
    ctx = context(spark, sf_dir)
    # the hash order of a fold is the same for every position: whole arrays change places
    t = ctx.mart.select("customer_id", "extra").join(ctx.folds, "customer_id").select(
        "customer_id", "fold", "extra")
    shuffled = SA.shuffle_within(t, ["fold"], "extra")
    each = F.posexplode(F.arrays_zip(F.col("extra").alias("value"), F.col("shuffled").alias("shuffled")))
    return shuffled.join(t, ["customer_id", "fold"]).select(
        "customer_id", "fold", each.alias("pos", "_e")).select(
        "customer_id", "pos", "fold", "_e.value", "_e.shuffled")


# -- E10 + J4: audit candidate sets ------------------------------------------------------------
# Candidate-set parameters.
ROW_STAT_COLS = ("row_extra_mean", "row_extra_min", "row_extra_max", "row_extra_sum",
                 "row_extra_null_count", "row_extra_zero_count", "row_extra_null_share",
                 "row_extra_zero_share")
AUDIT_MODES = ("selected_extra", "selected_extra_plus_row_stats", "feature_cols", "extra_and_num")
FORCE_PREFIXES = ("cat_feature_seg",)
EXCLUDE_PREFIXES = ("extra_tax",)
CANDIDATE_CAP = 12


def _starts_any(col, prefixes):
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.col(col).startswith(p)
    return cond


@query("audit_candidates", with_ctes(
    f"""SELECT mode, feature, (row_number() OVER (PARTITION BY mode ORDER BY k) - 1)::INTEGER AS position
FROM (SELECT mode, feature, min(k) AS k FROM (
        SELECT m.mode, b.feature, b.k FROM modes m JOIN base b ON
          (m.mode = 'selected_extra' AND b.kind = 'sel')
          OR (m.mode = 'selected_extra_plus_row_stats' AND b.kind IN ('sel', 'row'))
          OR (m.mode = 'feature_cols' AND b.kind IN ('num', 'cat', 'sel', 'row'))
          OR (m.mode = 'extra_and_num' AND b.kind IN ('num', 'sel'))
        UNION ALL
        SELECT m.mode, b.feature, 1000000 + b.k FROM modes m JOIN base b
          ON b.kind IN ('num', 'cat', 'sel', 'row') AND ({' OR '.join(f"starts_with(b.feature, '{p}')" for p in FORCE_PREFIXES)}))
      WHERE feature IN (SELECT feature FROM present)
        AND NOT ({' OR '.join(f"starts_with(feature, '{p}')" for p in EXCLUDE_PREFIXES)})
      GROUP BY mode, feature)
QUALIFY position < {CANDIDATE_CAP}""", "var_rank", "mart", "extra_long", "dict", extra=[
        ("modes", "SELECT * FROM (VALUES " + ", ".join(f"('{m}')" for m in AUDIT_MODES) + ") t(mode)"),
        ("base", "SELECT * FROM (VALUES " + ", ".join(
            [f"('{c}', 'num', {i})" for i, c in enumerate(MT.NUM_FEATURES)]
            + [f"('{c}', 'cat', {10 + i})" for i, c in enumerate(MT.CAT_FEATURES)]
            + [f"('{c}', 'row', {1000 + i})" for i, c in enumerate(ROW_STAT_COLS)])
         + ") t(feature, kind, k) UNION ALL SELECT feature, 'sel', 100 + rank FROM var_rank "
           f"WHERE rank <= {VAR_TOP_K}"),
        ("present", "SELECT DISTINCT d.feature FROM extra_long e JOIN dict d USING (pos) "
                    "WHERE e.is_test = 0 AND e.value IS NOT NULL UNION ALL SELECT * FROM (VALUES "
                    + ", ".join(f"('{c}')" for c in MT.NUM_FEATURES + MT.CAT_FEATURES + ROW_STAT_COLS)
                    + ") t(feature)"),
    ]))
def q_audit_candidates(spark, sf_dir):
    """E10 + J4: the audit's candidate lists for its four modes — selected extras,
    plus row statistics, all feature columns, extras and main numerics — with forced
    prefixes appended, excluded prefixes removed, intersected with the columns
    present in the train data, and capped (first n in list order)."""
    from pyspark.sql import Window
    ctx = context(spark, sf_dir)
    dic = _dictionary(spark)
    sel = PR.take_slice(PR.variance_ranking(ctx.extra_long, dic), top_k=VAR_TOP_K).select(
        "feature", F.lit("sel").alias("kind"), (F.col("rank") + 100).alias("k"))
    fixed = spark.createDataFrame(
        [(c, "num", i) for i, c in enumerate(MT.NUM_FEATURES)]
        + [(c, "cat", 10 + i) for i, c in enumerate(MT.CAT_FEATURES)]
        + [(c, "row", 1000 + i) for i, c in enumerate(ROW_STAT_COLS)], "feature STRING, kind STRING, k INT")
    base = fixed.unionByName(sel)
    kinds = {"selected_extra": ["sel"], "selected_extra_plus_row_stats": ["sel", "row"],
             "feature_cols": ["num", "cat", "sel", "row"], "extra_and_num": ["num", "sel"]}
    modes = spark.createDataFrame([(m, k) for m, ks in kinds.items() for k in ks],
                                  "mode STRING, kind STRING")
    chosen = modes.join(F.broadcast(base), "kind").select("mode", "feature", "k")
    forced = (spark.createDataFrame([(m,) for m in AUDIT_MODES], "mode STRING")
              .crossJoin(base.filter(_starts_any("feature", FORCE_PREFIXES)))
              .select("mode", "feature", (F.col("k") + 1000000).alias("k")))
    present = (ctx.extra_long.filter("is_test = 0 AND value IS NOT NULL").select("pos").distinct()
               .join(dic, "pos").select("feature")
               .unionByName(spark.createDataFrame(
                   [(c,) for c in MT.NUM_FEATURES + MT.CAT_FEATURES + ROW_STAT_COLS], "feature STRING")))
    cand = (chosen.unionByName(forced)
            .join(present.distinct(), "feature", "left_semi")          # J4: present columns only
            .filter(~_starts_any("feature", EXCLUDE_PREFIXES))
            .groupBy("mode", "feature").agg(F.min("k").alias("k")))
    w = Window.partitionBy("mode").orderBy("k")
    return (cand.withColumn("position", (F.row_number().over(w) - 1).cast("int"))
                .filter(F.col("position") < CANDIDATE_CAP).select("mode", "feature", "position"))
