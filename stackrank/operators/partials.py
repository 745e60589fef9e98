"""Sums of arrays that tasks compute over their Arrow batches.

A task yields one row per key with an array as bytes; ``summed`` adds the arrays of equal
keys. Keys spread over the shuffle's partitions and are added up as they stream in, so a
task holds its keys' sums and nothing that grows with the rows or the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 8 << 20


def key_schema(keys) -> str:
    return ", ".join(f"{k} int" for k in keys)


def partial_rows(keys, sums: dict):
    """Record batches (keys, blob) of a dictionary from key tuples to arrays."""
    rows, size = [], 0
    for k, v in sums.items():
        rows.append((*k, np.ascontiguousarray(v, "<f8").tobytes()))
        size += v.nbytes
        if size >= BATCH_BYTES:
            yield _batch(keys, rows)
            rows, size = [], 0
    if rows:
        yield _batch(keys, rows)


def _batch(keys, rows):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int32()) for c in cols[:-1]], pa.array(cols[-1], pa.binary())],
        names=[*keys, "blob"])


def summed(rows: DataFrame, keys, finish=None, schema: str | None = None) -> DataFrame:
    """(keys, blob) with the sums of equal keys; ``finish(key, array)`` may turn a sum into a
    dictionary of the columns of ``schema`` instead."""
    keys = list(keys)

    def add(batches):
        total: dict = {}
        for b in batches:
            blobs = b.column("blob").to_pylist()
            for *k, blob in zip(*[b.column(c).to_pylist() for c in keys], blobs):
                part = np.frombuffer(blob, "<f8")
                k = tuple(k)
                if k in total:
                    total[k] += part
                else:
                    total[k] = part.copy()
        if finish is None:
            yield from partial_rows(keys, total)
        elif total:
            out = [{**dict(zip(keys, k)), **finish(k, v)} for k, v in total.items()]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    if finish is None:
        return rows.repartition(*keys).mapInArrow(add, f"{key_schema(keys)}, blob binary")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    full = f"{key_schema(keys)}, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(full))
    return rows.repartition(*keys).mapInArrow(add, full)
