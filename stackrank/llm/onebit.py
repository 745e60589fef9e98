"""Inner-product search with randomly rotated one-bit codes.

A vector is centred, padded with zeros to the code length, turned by a random
orthogonal matrix and reduced to the signs of its components (one bit each), plus two
scalars: the length r of the centred vector
and the inner product a of its direction with its own code. For a query, turned in
the same way, <code, query> / a estimates the inner product with the direction; the
estimate's error is below ``eps * sqrt((1 - a^2) / (a^2 (b - 1)))`` times the query's
length, for b bits, except with a probability that falls like exp(-c eps^2). All vectors whose
upper bound reaches the k-th best exact score seen so far are scored exactly in double
precision; the others are never touched.

Equal vectors are one entry with their k + 1 smallest ids (a query's k nearest can
need no others, as ties go to the smaller id), so copies cost nothing.

The search is a stated query set against all rows in blocks: both sides are cut into
blocks of bounded size and each pair of blocks is one task group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackrank.llm.common import written

BLOCK_ROWS, QUERY_ROWS, CODE_BITS = 8192, 2048, 256
EPS = 3.5


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """The first ``dim`` rows of a random orthogonal matrix of ``bits`` rows and columns:
    turns vectors padded with zeros. Rows are orthonormal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(x: np.ndarray, centre: np.ndarray, rot: np.ndarray):
    """(packed bits, r, a) of the rows of ``x``."""
    y = (x - centre) @ rot
    r = np.linalg.norm(y, axis=1)
    a = np.abs(y).sum(axis=1) / np.sqrt(rot.shape[1]) / np.where(r > 0, r, 1)
    return np.packbits(y > 0, axis=1), r, np.where(r > 0, a, 1)


def search_block(x, first_id, bits, r, a, queries, centre, rot, k: int, eps: float):
    """For each query the best rows of the block and their scores, at least all that can
    hold one of its ``k`` nearest ids; ``first_id`` is the smallest id of each row."""
    b = rot.shape[1]
    code = np.unpackbits(bits, axis=1, count=b).astype(np.float32)
    code *= 2 / np.sqrt(b)
    code -= 1 / np.sqrt(b)
    scale = (r / a).astype(np.float32)
    miss = (eps * r * np.sqrt(np.maximum(0, 1 - a * a)) / a / np.sqrt(max(1, b - 1))).astype(
        np.float32)
    n = min(len(x), 2 * k)
    for lo in range(0, len(queries), 256):
        q = queries[lo:lo + 256]
        # <x, q> = r <direction, q> + <centre, q>
        est = ((q @ rot).astype(np.float32) @ code.T) * scale
        est += (q @ centre).astype(np.float32)[:, None]
        width = np.linalg.norm(q, axis=1).astype(np.float32)
        for i, e in enumerate(est):
            floor = -np.inf
            if n >= k:
                seed = np.argpartition(e, len(e) - n)[len(e) - n:]
                s = x[seed] @ q[i]
                floor = np.partition(s, n - k)[n - k]
            more = np.flatnonzero(e + miss * width[i] >= floor - 1e-5 * (1 + abs(floor)))
            s = x[more] @ q[i]
            order = np.lexsort((first_id[more], -s))[:k]
            yield lo + i, more[order], s[order]


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, _key, _vec) of the rows that take part: ``_vec`` is little-endian float64 and
    ``_key`` its digest. Null, empty, zero or non-finite vectors, vectors with null
    components and rows without an id take no part."""
    slim = df.select(F.col(id_col).cast("long").alias("_id"),
                     F.col(vec_col).cast("array<double>").alias("_v"))
    slim = slim.where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0))

    def run(batches):
        for b in batches:
            col = b.column("_v")
            off = np.asarray(col.offsets)
            flat = col.flatten() if off[0] == 0 else col.values.slice(off[0], off[-1] - off[0])
            vals = flat.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # nulls are NaN
            off = off - off[0]
            rows = [vals[s:e] for s, e in zip(off[:-1], off[1:])]
            ok = [bool(np.isfinite(v).all() and v.any()) for v in rows]
            raw = [v.tobytes() for v, o in zip(rows, ok) if o]
            ids = b.column("_id").filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([hashlib.md5(v).digest() for v in raw], pa.binary()),
                 pa.array(raw, pa.binary())], names=["_id", "_key", "_vec"])

    return slim.mapInArrow(run, "_id long, _key binary, _vec binary")


def nearest(df: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            every: int = 20, eps: float = EPS, seed: int = 7, block_rows: int = BLOCK_ROWS,
            query_rows: int = QUERY_ROWS, code_bits: int = CODE_BITS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each row whose id is
    divisible by ``every``, nearest first, ties to the smaller id, itself left out.

    A repeated id is one row for each distinct vector it has; an empty table gives no
    row; other columns are ignored. Vectors of another length than the most frequent
    one (ties: the longer) take no part.
    """
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vec_col).dropDuplicates(["_key", "_id"])
    # the k + 1 smallest ids of each distinct vector; Spark cuts each task's groups to
    # k + 1 rows before the shuffle, so a frequent vector makes no hot group
    top = Window.partitionBy("_key").orderBy("_id")
    small = rows.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k + 1)
    classes = written(small.groupBy("_key").agg(
        F.first("_vec").alias("_vec"), F.sort_array(F.collect_list("_id")).alias("_ids"))
        .withColumn("_dim", (F.octet_length("_vec") / 8).cast("int")), "vector-classes")
    dims = classes.groupBy("_dim").count().orderBy(F.desc("count"), F.desc("_dim")).first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], out_schema)
    dim, n = dims["_dim"], dims["count"]
    classes = classes.where(F.col("_dim") == dim)
    rot = rotation(dim, max(code_bits, -(-dim // 8) * 8), seed)
    # any centre is right; the mean of at most 10,000 vectors with the lowest digests
    sample = classes.orderBy("_key").limit(10_000).select("_vec").collect()
    centre = np.mean([np.frombuffer(s["_vec"], "<f8") for s in sample], axis=0)
    asked = rows.where(F.col("_id") % every == 0).select(F.col("_id").alias("query_id"), "_key")
    query_keys = asked.select("_key").distinct()
    queries = classes.join(query_keys, "_key", "left_semi").select("_key", "_vec")
    n_queries = queries.count()
    x_blocks = max(1, -(-n // block_rows))
    q_blocks = max(1, -(-n_queries // query_rows))

    coded_schema = "_key binary, _vec binary, _ids array<long>, _bits binary, _r double, _a double"

    def code(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("_vec").to_pylist()), "<f8").reshape(-1, dim)
                bits, r, a = encode(x, centre, rot)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_key"), b.column("_vec"), b.column("_ids"),
                     pa.array([v.tobytes() for v in bits], pa.binary()), pa.array(r),
                     pa.array(a)], names=["_key", "_vec", "_ids", "_bits", "_r", "_a"])

    coded = classes.select("_key", "_vec", "_ids").mapInArrow(code, coded_schema)
    part = lambda blocks, salt: F.pmod(F.xxhash64(F.lit(salt), "_key"), F.lit(blocks))
    cells_x = coded.withColumn("_x", part(x_blocks, 1)).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<long>")))
    cells_q = queries.withColumn("_q", part(q_blocks, 2)).withColumn(
        "_x", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1)).cast("array<long>")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["_key", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in cols})
        x = np.frombuffer(b"".join(left["_vec"]), "<f8").reshape(-1, dim)
        q = np.frombuffer(b"".join(right["_vec"]), "<f8").reshape(-1, dim)
        ids = [np.asarray(v) for v in left["_ids"]]
        first = np.array([v[0] for v in ids])
        bits = np.frombuffer(b"".join(left["_bits"]), np.uint8).reshape(len(x), -1)
        keys, found, scores, counts = right["_key"].tolist(), [], [], []
        asked_keys = []
        for i, where, s in search_block(x, first, bits, left["_r"].to_numpy(),
                                        left["_a"].to_numpy(), q, centre, rot, k + 1, eps):
            v = np.concatenate([ids[j] for j in where]) if len(where) else np.zeros(0, np.int64)
            sv = np.repeat(s, [len(ids[j]) for j in where])
            best = np.lexsort((v, -sv))[:k + 1]
            found.append(v[best])
            scores.append(sv[best])
            counts.append(len(best))
            asked_keys.append(keys[i])
        return pd.DataFrame({"_key": [y for y, c in zip(asked_keys, counts) for _ in range(c)],
                             "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    hits = (cells_x.groupBy("_x", "_q").cogroup(cells_q.groupBy("_x", "_q"))
            .applyInPandas(run, "_key binary, vec_id long, score double"))
    order = Window.partitionBy("_key").orderBy(F.desc("score"), "vec_id")
    # a repeated id may come with several vectors: its best score counts
    lists = (hits.groupBy("_key", "vec_id").agg(F.max("score").alias("score"))
             .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
             .groupBy("_key").agg(F.sort_array(F.collect_list(
                 F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))).alias("_l")))
    answer = asked.join(lists, "_key").withColumn(
        "_l", F.slice(F.filter("_l", lambda e: e["v"] != F.col("query_id")), 1, k))
    return (answer.select("query_id", F.posexplode("_l"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"),
                    F.col("col.v").alias("vec_id"), (-F.col("col.s")).alias("score")))


# brute force over all pairs
ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
      FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
