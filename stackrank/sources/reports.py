"""Report sources and sinks.

Reports are written by Spark and read back with explicit schemas, never parsed
on the driver:

* score report (JSON lines): ``model, macro_auc, target_scores MAP<STRING,DOUBLE>``;
  read back with ``macro_auc`` as text and ``try_cast`` (missing or unparsable ->
  null), ``explode`` of the map gives per-target rows;
* run log (JSON lines, append mode): one row per event, latest event per run by
  ``max_by``;
* CSV report with a header and an index column;
* prediction sink: Parquet partitioned by ``source`` (partition pruning on read).

Paths live under the session's shared checkpoint folder (a scratch folder per
call), never a machine-local temporary folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackrank.session import ensure_checkpoint_dir

SCORE_REPORT_SCHEMA = "model STRING, macro_auc STRING, target_scores MAP<STRING, DOUBLE>"
RUN_LOG_SCHEMA = "seq BIGINT, event STRING, run STRING, macro_auc DOUBLE, n_targets BIGINT"


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "stackrank-sinks", f"{name}-{uuid.uuid4().hex}")


def write_score_report(scores: DataFrame, path: str) -> None:
    """(model, target, auc) -> one JSON object per model with a score map."""
    rep = scores.groupBy("model").agg(
        F.avg("auc").alias("macro_auc"),
        F.map_from_entries(F.collect_list(F.struct("target", "auc"))).alias("target_scores"))
    rep.write.mode("overwrite").json(path)


def read_target_scores(spark: SparkSession, path: str) -> DataFrame:
    """(model, macro_auc DOUBLE or null, target, auc) from a score report."""
    rep = spark.read.schema(SCORE_REPORT_SCHEMA).json(path)
    return rep.select("model", F.col("macro_auc").try_cast("double").alias("macro_auc"),
                      F.explode("target_scores").alias("target", "auc"))


def append_run_log(events: DataFrame, path: str) -> None:
    """A10: append events (JSON lines); the writer never rewrites earlier events."""
    events.write.mode("append").json(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).json(path)


def latest_per_run(log: DataFrame) -> DataFrame:
    """The latest event of every run: ``max_by`` over the event sequence."""
    return log.groupBy("run").agg(
        F.max("seq").alias("seq"),
        F.max_by("event", "seq").alias("event"),
        F.max_by("macro_auc", "seq").alias("macro_auc"),
        F.max_by("n_targets", "seq").alias("n_targets"))


def write_csv_report(df: DataFrame, path: str, index_col: str) -> None:
    """CSV with a header; the index column first, the rest in sorted order."""
    cols = [index_col] + sorted(c for c in df.columns if c != index_col)
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def read_csv_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A5: CSV report with header and index column, read with an explicit schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """Prediction sink partitioned by source."""
    preds.write.mode("overwrite").partitionBy("source").parquet(path)


def read_predictions(spark: SparkSession, path: str, sources=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("source").isin(list(sources))) if sources else df
