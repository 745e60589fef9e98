"""Benchmark decontamination by winnowing.

Every run of ``SPAN`` = 10 words holds 6 five-word grams, and winnowing keeps the
smallest hash (the rightmost of equals) of every 6 consecutive grams. Two texts that
share 10 words share all 6 grams, hence keep the same one at the same place: no
shared span of 10 words or more can be missed. Each common fingerprint is extended
word by word in both directions; spans of 10 words or more are hits, which also
removes chance matches of the fingerprints. Items with fewer than 10 words are one
window of their own length and are looked up as such.

The test side is written as index files of bounded size to the shared folder; every
task streams its documents past each index file. Documents are never shuffled.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackrank.llm.common import open_fs, shared_folder, slices
from stackrank.llm.wordhash import grams, inside, words

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
INDEX_BYTES = 64 << 20
_MASK = np.uint64((1 << 22) - 1)


def winnow(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) kept: the rightmost minimum of each window of grams."""
    g = grams(hashes, GRAM)
    at = inside(counts, SPAN)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    n = len(g) - WINDOW + 1
    best, place = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, WINDOW):
        less = g[j:j + n] <= best
        best[less] = g[j:j + n][less]
        place[less] = j
    keep = np.zeros(len(g), bool)
    keep[at + place[at]] = True
    pos = np.flatnonzero(keep)
    return pos, g[pos]


def build_index(item_ids: list, hashes: np.ndarray, counts: np.ndarray) -> dict:
    """Arrays of one index: words and edges of the items, fingerprints, short windows."""
    ends = np.cumsum(counts)
    pos, fp = winnow(hashes, counts)
    order = np.argsort(fp, kind="stable")
    out = {"words": hashes, "ends": ends,
           "id": np.array([0 if i is None else i for i in item_ids], np.int64),
           "no_id": np.array([i is None for i in item_ids], bool),
           "fp": fp[order], "pos": pos[order],
           "item": np.searchsorted(ends, pos[order], "right")}
    for k in range(1, SPAN):
        i = np.flatnonzero(counts == k)
        if len(i):
            h = grams(hashes, k)[ends[i] - k]
            o = np.argsort(h, kind="stable")
            out[f"short{k}"], out[f"short{k}_item"] = h[o], i[o]
    return out


def _sieve(sorted_hashes):
    s = np.zeros(1 << 22, bool)
    s[sorted_hashes & _MASK] = True
    return s


def _matches(values, sorted_hashes, sieve):
    """Pairs (index in values, index in sorted_hashes) of equal hashes."""
    i = np.flatnonzero(sieve[values & _MASK])
    lo = np.searchsorted(sorted_hashes, values[i], "left")
    n = np.searchsorted(sorted_hashes, values[i], "right") - lo
    i, lo, n = i[n > 0], lo[n > 0], n[n > 0]
    ends = np.cumsum(n)
    return np.repeat(i, n), np.repeat(lo - ends + n, n) + np.arange(int(n.sum()))


class Index:
    def __init__(self, arrays: dict):
        self.a = arrays
        self.sieves = {k: _sieve(arrays[k]) for k in arrays
                       if k == "fp" or (k.startswith("short") and not k.endswith("_item"))}

    def spans(self, hashes, counts, fps):
        """Yield (document, item, start, end) of shared spans, in words of the batch."""
        a = self.a
        ends = np.cumsum(counts)
        pos, fp = fps
        for lo in range(0, len(pos), 1 << 18):        # pairs of a bounded part at a time
            i, j = _matches(fp[lo:lo + (1 << 18)], a["fp"], self.sieves["fp"])
            if not len(i):
                continue
            p, q, item = pos[lo + i], a["pos"][j], a["item"][j]
            order = np.lexsort((p, p - q, item))
            last, reach = None, 0
            for x, y, t in zip(p[order].tolist(), q[order].tolist(), item[order].tolist()):
                d = int(np.searchsorted(ends, x, "right"))
                if last == (d, t, x - y) and x < reach:
                    continue
                s, e = self._extend(hashes, int(ends[d] - counts[d]), int(ends[d]), x, y, t)
                last, reach = (d, t, x - y), e
                if e - s >= SPAN:
                    yield d, t, s, e
        for k in range(1, SPAN):
            if f"short{k}" in a:
                at = inside(counts, k)
                i, j = _matches(grams(hashes, k)[at], a[f"short{k}"], self.sieves[f"short{k}"])
                for x, t in zip(at[i].tolist(), a[f"short{k}_item"][j].tolist()):
                    yield int(np.searchsorted(ends, x, "right")), t, x, x + k

    def _extend(self, hashes, begin, end, x, y, t):
        lo = int(self.a["ends"][t - 1]) if t else 0
        hi = int(self.a["ends"][t])
        w = self.a["words"]
        m = min(x - begin, y - lo)
        ne = np.flatnonzero(hashes[x - m:x] != w[y - m:y])
        s = x - m + (int(ne[-1]) + 1 if len(ne) else 0)
        m = min(end - x, hi - y)
        ne = np.flatnonzero(hashes[x:x + m] != w[y:y + m])
        return s, x + (int(ne[0]) if len(ne) else m)


def write_index(bench: DataFrame, id_col: str, text_col: str) -> list:
    """Index files of at most about ``INDEX_BYTES`` of item text each; returns their paths
    (bounded by the benchmark's size over that)."""
    spark = bench.sparkSession
    folder = shared_folder(spark, "winnow-index")
    size = bench.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(size) // INDEX_BYTES + 1

    def run(batches):
        from pyspark import TaskContext
        ids, hs, cs = [], [], []
        for b in batches:
            h, c = words(b.column("_text"))
            ids += b.column("_id").to_pylist()
            hs.append(h)
            cs.append(c)
        if not ids:
            return
        out = io.BytesIO()
        np.savez(out, **build_index(ids, np.concatenate(hs), np.concatenate(cs)))
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        ctx = TaskContext.get()
        name = f"{root}/index-{ctx.partitionId()}"
        with fs.open_output_stream(f"{name}.{ctx.taskAttemptId()}") as f:
            f.write(out.getvalue())
        fs.move(f"{name}.{ctx.taskAttemptId()}", f"{name}.npz")
        yield pa.RecordBatch.from_pydict({"file": [f"index-{ctx.partitionId()}.npz"]})

    slim = bench.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    names = slim.repartition(parts).mapInArrow(run, "file string").collect()
    return [f"{folder}/{r['file']}" for r in sorted(names)]


_LOADED: dict[str, Index] = {}


def _load(uri: str) -> Index:
    if uri not in _LOADED:
        _LOADED.clear()                               # one index in memory at a time
        fs, path = open_fs(uri)
        with fs.open_input_file(path) as f:
            with np.load(io.BytesIO(f.read())) as z:
                _LOADED[uri] = Index({k: z[k] for k in z.files})
    return _LOADED[uri]


def _merge(spans: list) -> tuple[list, list]:
    starts, ends = [], []
    for s, e in sorted(spans):
        if starts and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def find_overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """``_id``, n_words, items (distinct ids of items with a shared window, ascending),
    span_start, span_end (disjoint word ranges that are hit) for every row of ``docs``,
    and the columns named in ``carry`` unchanged.

    Null texts have no words; an item without words never matches; items with a null
    id make hits but are not listed; repeated rows are each answered; an empty benchmark
    or table gives no hits or no rows. Other columns are ignored.
    """
    files = write_index(bench, item_col, item_text_col)
    kept = docs.select(F.col(id_col).cast("long").alias("_id"),
                       F.col(text_col).alias("_text"), *[docs[c] for c in carry])
    schema = ("_id long, n_words long, items array<long>, span_start array<long>, "
              "span_end array<long>")
    at_once = (2 << 20) if len(files) <= 1 else (32 << 20)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", at_once):
                h, c = words(part.column("_text"))
                first = np.cumsum(c) - c
                found: dict = {}
                fps = winnow(h, c)
                for uri in files:
                    index = _load(uri)
                    for d, t, s, e in index.spans(h, c, fps):
                        items, spans = found.setdefault(d, (set(), set()))
                        if not index.a["no_id"][t]:
                            items.add(int(index.a["id"][t]))
                        spans.add((s - int(first[d]), e - int(first[d])))
                rows = [found.get(d, ((), ())) for d in range(len(c))]
                merged = [_merge(s) if s else ([], []) for _, s in rows]
                cols = [part.column("_id"), pa.array(c, pa.int64()),
                        pa.array([sorted(i) for i, _ in rows], pa.list_(pa.int64())),
                        pa.array([m[0] for m in merged], pa.list_(pa.int64())),
                        pa.array([m[1] for m in merged], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    cols + [part.column(x) for x in carry],
                    names=["_id", "n_words", "items", "span_start", "span_end", *carry])

    for f in kept.schema.fields[2:]:
        schema += f", `{f.name}` {f.dataType.simpleString()}"
    return kept.mapInArrow(run, schema)


def n_hit():
    """Number of words inside spans."""
    return F.aggregate(F.zip_with("span_start", "span_end", lambda s, e: e - s),
                       F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Digest of ``find_overlaps``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return (find_overlaps(docs, bench)
            .select(F.col("_id").alias("doc_id"), "n_words", n_hit().alias("n_hit"),
                    F.size("items").cast("long").alias("n_items"),
                    F.sha2(ids, 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


# every 10-word window of the items (short items whole) against every run of the
# documents' words of the same length, by the words themselves
ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i
        FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT dg.r, dg.i, dg.k, win.item_id FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
pos AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
ids AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL)
  GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)
"""
