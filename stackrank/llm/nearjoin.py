"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Texts with equal sets are one class; every
later step works on one text of each class. Then:

1. MinHash signatures (252 values of 16 bits) in 42 bands of 6: classes that share a
   band meet in a bucket. A pair of similarity 0.8 shares no band with probability
   3e-6.
2. Inside a bucket pairs are compared 36 MinHash values at a time. With a uniform
   prior the similarity's posterior after m of n matches is Beta(m + 1, n - m + 1); a
   pair is dropped as soon as the probability of reaching the threshold is below
   ``tolerance``. What survives is kept as a spanning forest of the bucket, not as pairs.
3. The forests' components hold every pair that survives; all pairs inside a component
   are verified exactly on their shingle sets, again in bounded blocks. Each text
   gets the number of its links, and the verified links' components are the classes
   returned.

Large buckets and components are cut into chunks and every pair of chunks is one
group, so no group is unbounded, no pair leaves a task, and no link is lost.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackrank.llm.common import slices, trim, written
from stackrank.llm.components import components
from stackrank.llm.wordhash import mix, shingle_sets, words

SHINGLE, BANDS, ROWS, STEP = 5, 42, 6, 36
HASHES = BANDS * ROWS
BROADCAST_IDS = 2_000_000                  # 16 MB of hashes
COLUMNS = 1 << 14                          # shingles of a bitmap at a time
_rng = np.random.Generator(np.random.PCG64(97))
_A = (_rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_BAND = _rng.integers(1, 1 << 63, ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """252 MinHash values, folded to 16 bits each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4096):
        np.minimum(best, (x[None, lo:lo + 4096] * _A + _B).min(axis=1), out=best)
    return (mix(best.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One bucket key for each band and row of ``sig`` (n x 252)."""
    v = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    key = (np.arange(BANDS, dtype=np.uint64) * _BAND[ROWS])[None, :]
    key = np.broadcast_to(key, v.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key + v[:, :, r] * _BAND[r])
    return key.view(np.int64)


@lru_cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among ``n`` values at which P(similarity >= threshold) is at least
    ``tolerance``: with Beta(1, 1) as prior that is P(Binomial(n + 1, threshold) <= m)."""
    total, log = 0.0, math.log
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                          + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
        if total >= tolerance:
            return m
    return n


def survivors(sig: np.ndarray, i: int, others: np.ndarray, threshold: float,
              tolerance: float) -> np.ndarray:
    """Those of ``others`` that are not pruned against row ``i``."""
    matches = np.zeros(len(others), np.int32)
    for lo in range(0, HASHES, STEP):
        hi = min(lo + STEP, HASHES)
        matches += (sig[others, lo:hi] == sig[i, lo:hi]).sum(axis=1)
        keep = matches >= least_matches(hi, threshold, tolerance)
        if not keep.all():
            others, matches = others[keep], matches[keep]
        if not len(others):
            break
    return others


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int):
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def link_counts(sets: list, left: np.ndarray, right: np.ndarray, weights: np.ndarray,
                threshold: float, forest: Forest) -> np.ndarray:
    """Weighted number of links of each set, over pairs of ``left`` x ``right`` (all pairs
    i < j if they are the same); joins linked sets in ``forest``. Exact: bitmaps of
    the shingles that occur twice or more, counted in columns of bounded width."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    new = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = new[code[keep]], owner[keep]
    width = int(shared.sum())
    same = left is right
    links = np.zeros(n, np.int64)
    common = np.zeros((len(left), len(right)), np.int32)
    for lo in range(0, width, COLUMNS):
        m = (code >= lo) & (code < lo + COLUMNS)
        cols = min(COLUMNS, width - lo)
        bits = np.zeros((n, -(-cols // 64) * 64), bool)
        bits[owner[m], code[m] - lo] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        del bits
        for a, i in enumerate(left.tolist()):
            common[a] += np.bitwise_count(packed[right] & packed[i]).sum(axis=1, dtype=np.int32)
    for a, i in enumerate(left.tolist()):
        c = common[a].astype(np.int64)
        union = size[i] + size[right] - c
        ok = np.flatnonzero((c > 0) & (c >= threshold * union - 1e-9))
        j = right[ok]
        j = j[j > i] if same else j
        links[i] += weights[j].sum()
        np.add.at(links, j, weights[i])
        for x in j.tolist():
            forest.join(i, x)
    return links


def _shingle_rows(docs: DataFrame, with_sets: bool) -> DataFrame:
    """Per row of (doc_id, _rid, _text, ...): its set's digest and MinHash values, or the set."""
    rest = [c for c in docs.columns if c != "_text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema
                      if f.name != "_text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets(*words(part.column("_text")), SHINGLE)
                keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                if with_sets:
                    out = [s.astype("<u8").tobytes() for s in sets]
                else:
                    out = [signature(s).astype("<u2").tobytes() if len(s) else None
                           for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in rest]
                    + [pa.array(keys, pa.binary()), pa.array(out, pa.binary())],
                    names=[*rest, "_key", "_data"])

    return docs.mapInArrow(run, f"{kinds}, _key binary, _data binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, _key) of all buckets with two classes or more. A small bucket is named by
    its members, so buckets with the same members are kept once."""
    def spread(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("_data").to_pylist()), "<u2")
            keys = band_keys(sig.reshape(-1, HASHES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()),
                 b.column("_key").take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))],
                names=["bucket", "_key"])

    def meet(batches):
        last, held, count = None, [], 0

        def close():
            if 2 <= count <= len(held):                 # all members are held
                held.sort()
                name = int.from_bytes(hashlib.md5(b"".join(held)).digest()[:8], "little",
                                      signed=True)
                return [name] * len(held), held
            return [], []

        for b in batches:
            names, members = [], []
            for bucket, key in zip(b.column("bucket").to_pylist(), b.column("_key").to_pylist()):
                if bucket != last:
                    x, y = close()
                    names += x
                    members += y
                    last, held, count = bucket, [], 0
                count += 1
                if count <= 64:
                    held.append(key)
                else:                                   # a large bucket streams through
                    if count == 65:
                        names += [last] * 64
                        members += held
                    names.append(last)
                    members.append(key)
                    held = []
            if names:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(members, pa.binary())],
                    names=["bucket", "_key"])
        x, y = close()
        if x:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.binary())],
                                             names=["bucket", "_key"])

    rows = classes.select("_key", "_data").mapInArrow(spread, "bucket long, _key binary")
    met = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        meet, "bucket long, _key binary")
    return written(met.dropDuplicates(["bucket", "_key"]), "buckets")


def _blocks(rows: DataFrame, group: str, chunk: int, weight=None) -> DataFrame:
    """``rows`` dealt to pairs of chunks (_lo, _hi) of their group; groups of up to ``chunk``
    (rows, or sum of ``weight``) are one block. A row with _lo = _hi = its chunk is in
    the block of its own chunk; others hold it against one more chunk."""
    w = F.lit(1) if weight is None else weight
    sizes = (rows.groupBy(group).agg(F.sum(w).alias("_w")).where(F.col("_w") > chunk)
             .select(group, F.ceil(F.col("_w") / chunk).cast("long").alias("_k")))
    cut = rows.join(sizes, group, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    cut = cut.withColumn("_c", F.pmod(F.xxhash64("_key"), F.col("_k")))
    return (cut.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
            .withColumn("_lo", F.least("_c", "_o")).withColumn("_hi", F.greatest("_c", "_o"))
            .drop("_k", "_o"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6,
                    id_col: str = "doc_id", text_col: str = "text",
                    bucket_chunk: int = 1024, verify_chunk: int = 1 << 19) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, _rid, _first.

    ``class_id`` is the smallest doc_id among the rows that are linked (directly or over
    others), links being pairs of Jaccard similarity >= ``threshold`` on their sets
    of five-word shingles; ``n_links`` counts the other rows with a link to the row,
    copies included. A text of 1 to 4 words is one shingle; null, empty and wordless
    texts have none, are linked to nothing and are a class of their own. Repeated rows
    are copies. Null ids never name a class that has another id. Other columns are
    ignored; an empty table gives no row. ``_rid`` is a hash of (id, text), and
    ``_first`` marks the rows whose (id, _rid) is the class's smallest.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(F.col(id_col).cast("long"), text_col).alias("_rid"),
                       F.col(text_col).alias("_text"))
    rows = written(_shingle_rows(slim, False), "shingle-rows")
    one = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"),
                   F.col("_rid").alias("r"))
    classes = written(rows.where("_key IS NOT NULL").groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"), F.min(one).alias("_one"),
        F.any_value("_data").alias("_data")), "shingle-classes")

    met = _buckets(classes)
    blocks = _blocks(met, "bucket", bucket_chunk).join(classes.select("_key", "_data"), "_key")

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key")
        keys, chunk = pdf["_key"].tolist(), pdf["_c"].to_numpy()
        sig = np.frombuffer(b"".join(pdf["_data"]), "<u2").reshape(-1, HASHES)
        forest = Forest(len(keys))
        lo, hi = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
        right = np.flatnonzero(chunk == hi)
        for i in np.flatnonzero(chunk == lo).tolist():
            for j in survivors(sig, i, right[right > i] if lo == hi else right, threshold,
                               tolerance).tolist():
                forest.join(i, j)
        roots = [forest.find(i) for i in range(len(keys))]
        pairs = [(keys[i], keys[r]) for i, r in enumerate(roots) if i != r]
        trim()
        return pd.DataFrame(pairs, columns=["a", "b"])

    edges = blocks.groupBy("bucket", "_lo", "_hi").applyInPandas(prune, "a binary, b binary")
    joined = components(edges)
    groups = joined.select(F.col("a").alias("_key"), F.col("root").alias("_group")).union(
        joined.select(F.col("root").alias("_key"), F.col("root").alias("_group")).distinct())
    nodes = written(groups.join(classes.select("_key", "_n", F.col("_one.r").alias("_rid")),
                                "_key"), "near-nodes")

    # the shingle sets of the classes that are left, made again from one text of each; up
    # to BROADCAST_IDS hashes are sent to the scan, so that only those texts are shuffled;
    # beyond that size the join shuffles all
    some = slim.select("_rid", "_text")
    if nodes.count() <= BROADCAST_IDS:
        some = some.join(F.broadcast(nodes.select("_rid")), "_rid", "left_semi")
    texts = some.join(nodes, "_rid")
    sets = _shingle_rows(texts.withColumnRenamed("_key", "_own"), True).where("_key = _own")
    sets = written(sets.drop("_own").dropDuplicates(["_key"]), "near-sets")
    blocks = _blocks(sets, "_group", verify_chunk, F.octet_length("_data") / 8 + 512)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key")
        keys, chunk = pdf["_key"].tolist(), pdf["_c"].to_numpy()
        forest = Forest(len(keys))
        lo, hi = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
        left = np.flatnonzero(chunk == lo)
        right = left if lo == hi else np.flatnonzero(chunk == hi)
        links = link_counts([np.frombuffer(s, "<u8") for s in pdf["_data"]], left, right,
                            pdf["_n"].to_numpy(), threshold, forest) \
            if len(left) and len(right) else np.zeros(len(keys), np.int64)
        trim()
        return pd.DataFrame({"_key": keys, "_l": links,
                             "_root": [keys[forest.find(i)] for i in range(len(keys))]})

    checked = written(blocks.groupBy("_group", "_lo", "_hi").applyInPandas(
        verify, "_key binary, _l long, _root binary"), "near-links")
    linked = components(checked.select(F.col("_key").alias("a"), F.col("_root").alias("b")))
    counts = checked.groupBy("_key").agg(F.sum("_l").alias("_l"))
    info = (classes.select("_key", "_n", "_one").join(counts, "_key", "left")
            .join(linked.select(F.col("a").alias("_key"), "root"), "_key", "left")
            .withColumn("_root", F.coalesce("root", "_key")))
    first = info.groupBy("_root").agg(F.min("_one").alias("_first"), F.sum("_n").alias("_m"))
    # only classes with copies or links need a row
    named = (info.join(first, "_root").where("_m > 1")
             .select("_key", (F.coalesce("_l", F.lit(0)) + F.col("_n") - 1).alias("_links"),
                     "_first"))
    named = written(named, "near-classes")
    return (rows.select("doc_id", "_rid", "_key").join(named, "_key", "left")
            .select("doc_id", F.coalesce("_first.i", "doc_id").alias("class_id"),
                    F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), "_rid",
                    (F.col("_first").isNull() | (F.col("_first.r") == F.col("_rid"))
                     ).alias("_first")))


# exact similarities of all pairs that share a shingle; classes by smallest labels
ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 10 * c >= 8 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS low FROM r GROUP BY a),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(c.n, 0) AS n_links
FROM d LEFT JOIN k ON k.a = doc_id LEFT JOIN c ON c.a = doc_id
"""
