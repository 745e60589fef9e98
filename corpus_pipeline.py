"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the
columns of ``documents``; the last returns the packed sequences. ``run`` writes each
stage's rows to the shared folder and reads them back for the next one, so a lost
executor costs one stage at most.

Stages: documents scored as toxic go; of each group of near duplicates the row with the
smallest doc_id stays; documents that share ten words in a row with the benchmark go;
personal data is replaced by surrogates; the rest is packed.

Nulls and empty texts are kept by all filters (no toxic terms, no shingles, no benchmark
words) and packed as an end id; repeated rows are near duplicates of each other; an
empty table gives an empty result; columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackrank.llm.common import prepare, table, written
from stackrank.llm.decontaminate import find_overlaps
from stackrank.llm.nearjoin import near_duplicates
from stackrank.llm.packing import pack_documents
from stackrank.llm.pii import replace_pii
from stackrank.llm.toxicity import score_documents, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the toxicity model on the labelled rows of ``docs``; drops the rows with a score
    of 0.5 or more."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, carry=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 0").select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: the smallest (doc_id, hash)."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    classes = near_duplicates(docs)
    gone = classes.where("NOT _first").select("_rid").distinct()
    kept = docs.withColumn("_rid", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    kept = kept.join(written(gone, "duplicate-rows"), "_rid", "left_anti")
    # rows that repeat id and text: one of them stays, unless they have no shingles
    again = (classes.where("_first AND n_links > 0").groupBy("_rid").count().where("count > 1")
             .select("_rid"))
    again = written(again, "repeated-rows")
    one = kept.join(again, "_rid", "left_semi").dropDuplicates(["_rid"])
    return (kept.join(again, "_rid", "left_anti").unionByName(one)).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that share a window of ten words (or a whole shorter item) with the
    benchmark."""
    prepare(spark)
    found = find_overlaps(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"),
                          carry=("text", "lang", "source", "n_chars"))
    return found.where(F.size("span_start") == 0).select(
        F.col("_id").alias("doc_id"), "text", "lang", "source", "n_chars")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text."""
    prepare(spark)
    done = replace_pii(docs.select(*COLUMNS), carry=("lang", "source"))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 ids."""
    prepare(spark)
    return pack_documents(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", remove_toxic), ("near_duplicates", remove_near_duplicates),
          ("decontamination", remove_benchmark), ("pii", replace_personal_data),
          ("packing", pack)]

# the toxicity model and the surrogates have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
