"""Helpers shared by the operators: tables, the shared folder, keyed placement.

Files that tasks exchange live only below ``spark.checkpoint.dir`` (a folder that
all executors share); they are written and read with ``pyarrow.fs``, which
resolves the URI of the folder, so nothing depends on a machine-local path.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import stackrank
from stackrank.session import ensure_checkpoint_dir

SHIPPED = "stackrank.llm.shipped"


def prepare(spark: SparkSession) -> None:
    """Set up the checkpoint folder and send this package to the executors, so that
    their Python workers can import it whatever their working directory is."""
    ensure_checkpoint_dir(spark)
    if spark.conf.get(SHIPPED, None) == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.abspath(stackrank.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="stackrank-code-"), "stackrank_code.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out)
    spark.conf.set(SHIPPED, spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """Full URI of a new folder below the shared checkpoint folder."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{fs.makeQualified(path).toString().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage,
    survives lost executors, and gives Catalyst the true size for its joins."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the folder of a table that ``written`` made and nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str):
    """(filesystem, path) of a URI, for use inside tasks."""
    from pyarrow import fs
    # file:/x and file:///x are the same place
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def one_blob(rows: DataFrame, make, name: str) -> str:
    """``make(batches)`` (bytes) over all of ``rows``, whose size must have a bound, in one
    task; the place of a file in the shared folder with the result."""
    place = shared_folder(rows.sparkSession, name)

    def write(raw: bytes) -> str:
        # every attempt has a file of its own; the one whose name comes back is whole
        fs, path = open_fs(place)
        fs.create_dir(path)
        file = f"part-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{path}/{file}") as out:
            out.write(raw)
        return file

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([write(make(batches))])], names=["file"])

    got = rows.repartition(1).mapInArrow(run, "file string").first()
    # without rows there may be no task
    return f"{place}/{got['file'] if got else write(make([]))}"


_LOADED: dict[str, object] = {}


def load_blob(place: str):
    """The pickled object of such a file; the last one of a worker process stays loaded."""
    if place not in _LOADED:
        import pickle
        fs, path = open_fs(place)
        with fs.open_input_stream(path) as f:
            made = pickle.loads(f.read())
        _LOADED.clear()
        _LOADED[place] = made
    return _LOADED[place]


def trim() -> None:
    """Give memory that the worker process has freed back to the system: workers live on
    through all stages of a job, and an executor pays for the largest each has ever been."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:                                     # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20):
    """Cut a record batch into row ranges of at most ``max_bytes`` of ``column``
    (one row at least), so that memory follows bytes, not rows."""
    n = batch.num_rows
    if n == 0:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, b in enumerate(lens):
        if i > start and size + b > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += b
    yield batch.slice(start, n - start)
    trim()


def sorted_bounds(df: DataFrame, key: str, shards: int, per_shard: int = 24) -> list:
    """At most ``shards - 1`` ascending split points of ``key``.

    Taken from the rows whose key hashes lowest (a sample that depends on the
    keys alone, not on partitions, so that a re-run gives the same shards). Its
    size is ``shards * per_shard`` keys, bounded by the number of output files.
    """
    if shards <= 1:
        return []
    keys = df.where(F.col(key).isNotNull()).select(key)
    rows = keys.orderBy(F.xxhash64(F.lit(7), key), key).limit(shards * per_shard).collect()
    vals = sorted(r[0] for r in rows)
    cuts = [vals[len(vals) * i // shards] for i in range(1, shards)] if vals else []
    return sorted(set(cuts))


def shard_of(key: str, bounds: list) -> Column:
    """Number of split points <= key, by binary search in a literal array (log2 steps
    inside the JVM); null keys go first."""
    if not bounds:
        return F.lit(0)
    steps, s = [], 1
    while s <= len(bounds):
        steps.append(s)
        s *= 2
    arr, n = F.array(*[F.lit(b) for b in bounds]), len(bounds)
    pos = F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0),
        lambda lo, step: F.when((lo + step <= n)
                                & (F.try_element_at(arr, lo + step) <= F.col(key)),
                                lo + step).otherwise(lo))
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(pos)


def range_shards(df: DataFrame, key: str, weight: Column, shard_bytes: int,
                 extra_sort=()) -> tuple[DataFrame, int]:
    """``df`` with an int column ``_shard``, placed so that task ``i`` holds exactly
    shard ``i`` in order of (key, *extra_sort). One shuffle; the split points come
    from the keys, so every run writes the same files."""
    total = df.agg(F.sum(weight).alias("b")).first()["b"] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    bounds = sorted_bounds(df, key, shards)
    out = (df.withColumn("_shard", shard_of(key, bounds).cast("int"))
             .repartitionById(len(bounds) + 1, F.col("_shard"))
             .sortWithinPartitions("_shard", key, *extra_sort))
    return out, len(bounds) + 1


def same(a: DataFrame, b: DataFrame, names) -> Column:
    """Equality of the columns ``names`` of two tables; null equals null."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def numbered(df: DataFrame, by: list, order: list, name: str) -> DataFrame:
    """``df`` with longs ``_pos`` (0-based position within the group ``by``, whose columns are
    named; nulls are a group) in the order of the columns ``order`` and ``_n`` (the group's rows).

    The rows are sorted by ranges of (by, order), so that a group of any size spreads over
    many tasks, and written; a row's position is its place in its range plus the group's rows
    in the ranges before. Only those counts (ranges + groups rows) are joined back. Rows that
    are equal in all of it are spread too: the place in the input comes last.
    """
    keys = [F.col(c) for c in by] + list(order) + [F.col("_tie")]
    base = written(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
        # the range in the upper 31 bits, the place in it in the lower 33
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_row", 33)), name)
    counts = base.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"),
                                             F.min("_row").alias("_low"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select(
        *by, "_range", "_low", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(group).alias("_n")), name + "-starts")
    return (base.join(starts, same(base, starts, [*by, "_range"]))
            .select(*[base[c] for c in df.columns],
                    (base["_row"] - starts["_low"] + starts["_before"]).alias("_pos"),
                    starts["_n"]))
