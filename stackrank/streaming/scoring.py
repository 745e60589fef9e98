"""Structured Streaming scoring of prediction sources as they land.

Base models write their predictions into the prediction sink (Parquet,
partitioned by ``source``). A file-source stream over that folder picks up every
new source; each micro-batch joins the OOF rows to the labels (a static table)
and appends positives and negatives per (target, source, score) to a count table.
``foreachBatch`` writes each batch into its own ``batch=<id>`` folder with overwrite, so
a batch replayed after a failure replaces its own output (exactly-once effect); the
stream's progress lives in a checkpoint under the shared checkpoint folder.

Counts add up, so a source may land in any number of writes: the reader merges all
batches and computes the exact AUCs of everything seen so far.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackrank.operators.metrics import auc_from_counts, collapse_scores

PRED_SCHEMA = "split STRING, target STRING, customer_id BIGINT, score DOUBLE, source STRING"


def start_scoring(spark: SparkSession, pred_dir: str, labels: DataFrame, score_dir: str,
                  checkpoint_dir: str, available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    stream = spark.readStream.schema(PRED_SCHEMA).parquet(pred_dir)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        oof = batch.filter("split = 'oof'").join(labels, ["target", "customer_id"])
        counts = collapse_scores(oof, ["target", "source"])
        counts.write.mode("overwrite").parquet(os.path.join(score_dir, f"batch={batch_id}"))

    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_scores(spark: SparkSession, score_dir: str) -> DataFrame:
    """(target, source, n_pos, n_neg, auc) over all batches."""
    counts = spark.read.parquet(score_dir).groupBy("target", "source", "_s").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"))
    return auc_from_counts(counts, ["target", "source"])
