"""Rendezvous hashing of record keys over weighted shards, with DataFrame functions only.

Each (key, shard) pair has a uniform value u from an MD5 digest; the shard with the
largest ``-weight / ln(u)`` takes the key. The choice depends on the key, the shard
numbers and the weights alone, so rows never need to be compared, and one shard
more can only take keys to itself (an expected share of its weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackrank.llm.common import written

BUCKET_HEX = 3


def _text(c) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _scores(key: Column, weights: list) -> Column:
    """Array of (score, -shard) for all shards; the largest wins, ties to the lower shard."""
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w"))
                       for i, w in enumerate(weights)])

    def score(s):
        digest = F.md5(F.concat(key, F.lit(":"), s["i"].cast("string")))
        h = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
        return F.struct((-s["w"] / F.ln((h + 0.5) / F.lit(float(1 << 52)))).alias("s"),
                        (-s["i"]).alias("n"))

    return F.transform(shards, score)


def assign_shards(df: DataFrame, key: str, weights: list, extra: list = ()) -> DataFrame:
    """Add ``shard`` by weighted rendezvous hashing of ``key`` and, if ``extra`` weights
    are given, ``grown_shard`` with those shards added. No shuffle. Null keys hash like
    the string 'null'. Weights must be positive."""
    if any(w <= 0 for w in [*weights, *extra]):
        raise ValueError("weights must be positive")
    n = len(weights)
    out = df.withColumn("_all", _scores(_text(F.col(key)), [*weights, *extra]))
    out = out.withColumn("shard", -F.array_max(F.slice("_all", 1, n))["n"])
    if extra:
        out = out.withColumn("grown_shard", -F.array_max("_all")["n"])
    return out.drop("_all")


def shard_documents(docs: DataFrame, shards: int = 40, weights: list | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``size`` is the text's UTF-8 bytes plus 16; ``slot`` numbers a shard's rows from 0
    in order of (md5 of id and crc, id, size, crc). Rows that agree in all of these are
    counted before the shuffle and numbered as a run, so repeated rows make no hot
    group; the others are numbered in 4096 hash buckets a shard, and a table of
    (shard, bucket) counts, at most 4096 rows a shard, gives each bucket's first slot.
    Null texts have size 16 and crc 0; null ids are hashed as 'null'; other columns
    are ignored; an empty table gives no row.
    """
    weights = weights or [1.0] * shards
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    rows = assign_shards(base, "doc_id", weights, [1.0]).withColumn(
        "_o", F.md5(F.concat(F.lit("slot:"), _text(F.col("doc_id")), F.lit(":"),
                             F.col("text_crc32").cast("string"))))
    rows = rows.withColumn("_b", F.substring("_o", 1, BUCKET_HEX))
    runs = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")), "shard-runs")
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = (runs.groupBy("shard", "_b").agg(F.sum("_n").alias("_t"))
             .select("shard", "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_f")))
    within = (Window.partitionBy("shard", "_b").orderBy("_o", "doc_id", "size", "text_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("_f") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    # bounded by shards x 4096 rows whatever the input
    return (runs.join(F.broadcast(first), ["shard", "_b"])
            .withColumn("_s", start)
            .withColumn("slot", F.explode(F.sequence("_s", F.col("_s") + F.col("_n") - 1)))
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                    "grown_shard"))


# crc32 bytewise by the usual table of the reflected polynomial 0xEDB88320
ORACLE = r"""
WITH tab AS MATERIALIZED (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(n))),
d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS x FROM documents),
c AS MATERIALIZED (
  SELECT doc_id, CAST(strlen(x) + 16 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295,
      list_transform(regexp_extract_all(hex(encode(x)), '..'),
        lambda h: CAST('0x' || h AS BIGINT))),
      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]))) AS text_crc32
  FROM d, tab),
s AS (
  SELECT doc_id, size, text_crc32, i,
    -1.0 / ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || i),
                                   1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS w, r
  FROM (SELECT *, row_number() OVER () AS r FROM c), range(41) g(i)),
a AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(size) AS size,
    any_value(text_crc32) AS text_crc32,
    CAST(arg_max(i, w) FILTER (WHERE i < 40) AS INTEGER) AS shard,
    CAST(arg_max(i, w) AS INTEGER) AS grown_shard
  FROM s GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY
    md5('slot:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32),
    doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM a
"""
