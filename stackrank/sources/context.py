"""Materialised shared inputs of a scale-factor directory.

Mart, labels, folds and prediction sources feed almost every query, and each is
referenced several times inside one plan (folds read the labels four times,
every source reads labels and folds). Left lazy, Spark re-derives them in every
branch. They are therefore written once per session below ``spark.checkpoint.dir`` (a shared
folder on a cluster), as Parquet tables or a reliable checkpoint: later plans start
from those files, and a lost executor re-reads them instead of recomputing the
lineage.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from stackrank.session import ensure_checkpoint_dir

_MEMO: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the input files, by Hadoop's file system (any store)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime())
                        for f in fs.listStatus(path)))


BUCKETED_CONF = "stackrank.context.bucketed"
BUCKET_KEY = "customer_id"


def _bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(spark: SparkSession, key: tuple, build, bucket: bool = False,
                partition: tuple = ()) -> DataFrame:
    """Materialise once per session in the shared checkpoint folder. Entity-keyed tables
    (``bucket=True``) are bucketed and sorted by ``customer_id``, so joins and
    aggregations between them on the entity key need no shuffle; tables with
    ``partition`` columns are Parquet folders by them, so that filters on these skip
    files; other results use a reliable checkpoint."""
    base = ensure_checkpoint_dir(spark)
    k = (spark.sparkContext.applicationId, *key)
    df = _MEMO.get(k)
    if df is not None:
        return df
    built = build()
    name = f"stackrank_{hashlib.md5(repr(k).encode()).hexdigest()[:16]}_{uuid.uuid4().hex[:8]}"
    path = f"{base.rstrip('/')}/stackrank-tables/{name}"
    if partition:
        built.write.partitionBy(*partition).parquet(path)
        df = spark.read.schema(built.schema).parquet(path).select(*built.columns)
    elif bucket and BUCKET_KEY in built.columns and \
            spark.conf.get(BUCKETED_CONF, "true").lower() == "true":
        # Matching join keys on bucketed sides need not cover all join columns.
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        (built.write.option("path", path).bucketBy(_bucket_count(spark), BUCKET_KEY)
              .sortBy(BUCKET_KEY).saveAsTable(name))
        df = spark.table(name)
    else:
        df = built.checkpoint(eager=True)
    _MEMO[k] = df
    return df


class Context:
    """Lazily materialised inputs: ``mart``, ``labels_array``, ``folds`` and the scores per
    customer, with ``labels``, ``preds`` and ``oof_scored`` exploded from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._key = (sf_dir.rstrip("/"), _stamp(spark, sf_dir))

    # Entity tables joined with each other on customer_id in most plans.
    BUCKETED = ("mart", "labels_array", "folds", "scores")

    def _get(self, name: str, build) -> DataFrame:
        df = materialize(self.spark, (*self._key, name), build, bucket=name in self.BUCKETED)
        # Their files are small for their rows (sorted, encoded): never judged fit for a
        # broadcast by the size of the files.
        return df.hint("merge") if name in self.BUCKETED else df

    @property
    def mart(self) -> DataFrame:
        from stackrank.sources.mart import build_mart
        return self._get("mart", lambda: build_mart(self.spark, self.sf_dir))

    @property
    def labels_array(self) -> DataFrame:
        """(customer_id, ys ARRAY<INT>): the labels of a customer in one row."""
        from stackrank.sources.mart import labels_array
        return self._get("labels_array", lambda: labels_array(self.mart))

    @property
    def labels(self) -> DataFrame:
        from stackrank.sources.mart import labels_long
        return labels_long(self.labels_array)

    @property
    def folds(self) -> DataFrame:
        from stackrank.operators.folds import multilabel_folds
        return self._get("folds", lambda: multilabel_folds(self.labels))

    @property
    def scores(self) -> DataFrame:
        """The sources' scores of all targets in arrays per customer."""
        from stackrank.sources.predictions import build_scores
        return self._get("scores", lambda: build_scores(self.mart, self.labels_array, self.folds))

    @property
    def preds(self) -> DataFrame:
        """The long table of predictions: exploded inside each plan from the scores per
        customer, never written out. It keeps their layout by customer."""
        from stackrank.sources.predictions import long_sources
        return long_sources(self.scores)

    @property
    def extra_long(self) -> DataFrame:
        """The extra block in long form, exploded from the mart's array inside each plan
        (right below its partial aggregation): never written out."""
        from stackrank.sources.mart import extra_long
        return extra_long(self.mart)

    def _oof(self) -> DataFrame:
        """The OOF rows of ``scores`` with their customers' labels (never by row order)."""
        return self.scores.filter("split = 'oof'").join(self.labels_array, "customer_id")

    def oof_scored(self) -> DataFrame:
        """OOF predictions joined to their labels by key."""
        from stackrank.sources.predictions import long_sources
        return long_sources(self._oof()).select(
            "target", "customer_id", "split", "source", "score", "y")

    def source_auc(self) -> DataFrame:
        """AUC per (target, source): sorted once per session, read by reports and routing."""
        from stackrank.operators.metrics import auc_from_counts
        from stackrank.sources.predictions import score_counts
        return self._get("source_auc", lambda: auc_from_counts(
            score_counts(self._oof()), ["target", "source"]))

    def fold_auc(self) -> DataFrame:
        """AUC per (target, source, fold), once per session."""
        from stackrank.operators.metrics import auc_from_counts
        from stackrank.sources.predictions import score_counts
        return self._get("fold_auc", lambda: auc_from_counts(
            score_counts(self._oof().join(self.folds, "customer_id"), ["fold"]),
            ["target", "source", "fold"]))


def context(spark: SparkSession, sf_dir: str) -> Context:
    return Context(spark, sf_dir)


def stored(df: DataFrame, per_file: int = 0, partition: tuple = ()) -> DataFrame:
    """``cut`` for a table with a row per entity or score: Parquet below the shared
    checkpoint folder, a fraction of a checkpoint's size. ``per_file`` rows at most share a
    file: packed rows are megabytes each, and a reader takes 4,096 rows of a file at once.
    Filters on the ``partition`` columns skip files."""
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/stackrank-tables/stored-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", per_file).partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a sub-result that later plans reference several times
    (a per-target table, a pool, a sample): reliable checkpoint into the shared
    checkpoint folder, so it is computed once and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
