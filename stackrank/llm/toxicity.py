"""Toxicity scores by a factorization machine over hashed terms.

Terms are whole words and the first 4 to 8 bytes of longer words, hashed to 2^23
places; a place has parameters if it occurs in ``LEAST_DOCS`` documents of the fit. A
document's score is ``w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)``
over its distinct terms, through a sigmoid: besides a weight of its own each term has
a vector, so that a pair of terms can say more than both alone. A text is scored by
its windows of 128 words (half overlapping, so that every pair within 64 words shares
a window) and takes its highest window's score: one insult weighs as much in a long
text as in a short one.

The model is fitted in one task on a bounded sample of labelled rows (at most
``rows_per_class`` of each class and ``sample_bytes`` of text, those with the lowest hash of
their id) and handed to the scoring tasks as a file in the shared folder: 9 floats a place.
Neither the sample nor the model passes the driver.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackrank.llm.common import dropped, load_blob, one_blob, slices, written
from stackrank.llm.wordhash import (LOW_BYTES, LOWER, eights, mix, span_hashes, text_buffer,
                                    word_spans)

BITS, FACTORS, LEAST_DOCS = 23, 8, 3
PREFIXES = (4, 5, 6, 7, 8)
WINDOW, HOP = 128, 64


def terms(data: np.ndarray, offs: np.ndarray):
    """(place, word number) of every term, and the number of words of each text."""
    starts, ends = word_spans(data, offs)
    counts = np.diff(np.searchsorted(starts, offs))
    lens = ends - starts
    if not len(lens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    data = LOWER[data]
    eight = eights(data)
    place, word = [span_hashes(data, starts, ends, window=eight)], [np.arange(len(lens))]
    for n in PREFIXES:
        i = np.flatnonzero(lens > n)
        place.append(mix(mix(eight[starts[i]] & LOW_BYTES[n]) + np.uint64(n * 2 + 1)))
        word.append(i)
    place = (np.concatenate(place) >> np.uint64(64 - BITS)).astype(np.int64)
    return place, np.concatenate(word), counts


def windows(place: np.ndarray, word: np.ndarray, counts: np.ndarray):
    """Distinct (window, place) pairs, sorted, and the text of each window. A text without
    words is a window without terms."""
    per = np.maximum(1, -(-(counts - HOP) // HOP))        # windows of each text
    first = np.cumsum(per) - per
    doc_of_word = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(doc_of_word)) - np.repeat(np.cumsum(counts) - counts, counts)
    hop = np.minimum(pos // HOP, per[doc_of_word] - 1) + first[doc_of_word]
    back = (pos >= HOP) & (pos // HOP < per[doc_of_word])  # also in the window before
    key = np.concatenate([hop[word], (hop - 1)[word][back[word]]]) << BITS
    key += np.concatenate([place, place[back[word]]])
    key = np.unique(key)
    return key >> BITS, key & ((1 << BITS) - 1), np.repeat(np.arange(len(counts)), per)


class Vocabulary:
    """Places with parameters, numbered; others are left out of a text's terms."""

    def __init__(self, places: np.ndarray):
        self.places, self._known = np.sort(places), None

    def __getstate__(self):
        return self.places

    def __setstate__(self, places):
        self.places, self._known = places, None

    def __len__(self):
        return len(self.places)

    def keep(self, place, word, counts):
        if self._known is None:
            self._known = np.zeros(1 << BITS, bool)
            self._known[self.places] = True
        known = self._known[place]
        return np.searchsorted(self.places, place[known]), word[known], counts


class Machine:
    def __init__(self, vocabulary: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        self.w0 = np.float32(0)
        self.w = np.zeros(len(vocabulary), np.float32)
        self.v = (rng.standard_normal((len(vocabulary), FACTORS)) * 0.005).astype(np.float32)

    def pruned(self, least: float = 0.05) -> "Machine":
        """Without the places whose weight is zero and whose vector is shorter than ``least``:
        they change no score by much, and texts have far fewer terms to add up."""
        keep = (self.w != 0) | (np.linalg.norm(self.v, axis=1) >= least)
        out = Machine(Vocabulary(self.vocabulary.places[keep]))
        out.w0, out.w, out.v = self.w0, self.w[keep], self.v[keep]
        return out

    def raw(self, win: np.ndarray, place: np.ndarray, n: int):
        """Score of each of ``n`` windows before the sigmoid, and the factor sums."""
        lin = np.bincount(win, weights=self.w[place], minlength=n)
        edges = np.searchsorted(win, np.arange(n + 1))
        sums = np.zeros((n, FACTORS))
        squares = np.zeros(n)
        live = edges[1:] > edges[:-1]
        if live.any():
            at = edges[:-1][live]
            for f in range(FACTORS):                    # one factor at a time: 8 bytes a term
                v = self.v[place, f].astype(np.float64)
                sums[live, f] = np.add.reduceat(v, at)
                squares[live] += np.add.reduceat(v * v, at)
        return self.w0 + lin + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, place, word, counts) -> np.ndarray:
        """Probability of each text: that of its highest window."""
        if not len(counts):
            return np.zeros(0)
        win, pl, doc = windows(*self.vocabulary.keep(place, word, counts))
        y, _ = self.raw(win, pl, len(doc))
        first = np.searchsorted(doc, np.arange(len(counts)))
        return 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(y, first), -30, 30)))


def fit(vocabulary: Vocabulary, docs: list, labels: np.ndarray, epochs: int = 6, rate: float = 0.1,
        pair_rate: float = 0.01, sparse: float = 0.02, pair_decay: float = 1e-3,
        batch: int = 256, seed: int = 5, sizes: dict | None = None,
        lift: float = 0.8) -> Machine:
    """Fit on (terms of each window, places) of whole documents with 0/1 labels by AdaGrad
    on the log loss of each document's highest window: the weights alone for half of the
    epochs, then the vectors too, more slowly and drawn to zero, so that they say only
    what the weights cannot. Weights are drawn to zero by ``sparse`` a step (an L1 penalty),
    which leaves the terms that many documents agree on. ``sizes`` are the classes' sizes
    where the documents are a sample of each; a class of share q weighs q^-lift as
    much per document as it would in the whole."""
    m = Machine(vocabulary, seed)
    if not len(labels) or labels.min() == labels.max():
        m.w0 = np.float32(4 if len(labels) and labels[0] else -4)
        return m
    rng = np.random.default_rng(seed)
    share = np.array([(labels == c).mean() for c in (0, 1)])
    whole = np.array([sizes[0], sizes[1]], float) if sizes else share
    whole /= whole.sum()
    each = whole ** (1 - lift) / (whole ** (1 - lift)).sum() / share
    weight = each[labels.astype(int)]
    gw, gv, g0 = np.full(m.w.shape, 1e-2), np.full(m.v.shape, 1e-2), 1e-2
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            part = order[lo:lo + batch]
            n = np.array([len(docs[i][0]) for i in part])
            base = np.cumsum(n) - n
            win = np.repeat(np.arange(int(n.sum())), np.concatenate([docs[i][0] for i in part]))
            place = np.concatenate([docs[i][1] for i in part])
            y, sums = m.raw(win, place, int(n.sum()))
            top = np.array([b + int(np.argmax(y[b:b + k])) for b, k in zip(base, n)])
            p = 1 / (1 + np.exp(-np.clip(y[top], -30, 30)))
            grad = np.zeros(len(y))
            grad[top] = (p - labels[part]) * weight[part] / len(part) * 16
            use = grad[win] != 0
            win, place = win[use], place[use]
            g = grad[win]
            g0 += grad.sum() ** 2
            m.w0 -= np.float32(rate * grad.sum() / np.sqrt(g0))
            u, inv = np.unique(place, return_inverse=True)
            dw = np.bincount(inv, weights=g)
            gw[u] += dw * dw
            w = m.w[u] - rate * dw / np.sqrt(gw[u])
            m.w[u] = np.sign(w) * np.maximum(0, np.abs(w) - rate * sparse / np.sqrt(gw[u]))
            if epoch < epochs // 2:
                continue
            if not len(u):                              # no known term in the batch
                continue
            dv = np.stack([np.bincount(inv, weights=g * (sums[win, f] - m.v[place, f]))
                           for f in range(FACTORS)], 1) + pair_decay * m.v[u]
            gv[u] += dv * dv
            m.v[u] -= (pair_rate * dv / np.sqrt(gv[u])).astype(np.float32)
    return m.pruned()


def held_out(id_col, mod: int, rest: int):
    """crc32(id as text) mod ``mod`` = ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int,
                    rows_per_class: int, sample_bytes: int) -> DataFrame:
    """(_id, _y, _n, _text) of at most ``rows_per_class`` labelled ids of each class outside the
    held-out ids, those with the lowest hash, as long as their texts stay within
    ``sample_bytes`` in all (half for each class); a column ``_n`` holds the class's size.

    Ids or labels that are null and labels other than 0 and 1 take no part; an id that occurs
    more than once counts once, with its smallest text (null counts as empty); very long
    texts count whole, and one that does not fit ends the sample of its class; other
    columns are ignored; empty tables give no row.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"),
                           F.col(label).cast("int").alias("_y"))
             .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)
                    & ~held_out(F.col("_id"), mod, rest))
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    parts = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id")
             .limit(rows_per_class).withColumn("_n", F.lit(sizes[y]).cast("long"))
             for y in sorted(sizes)]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([], "_id long, _y int, _n long") if not parts else parts[0]
    for p in parts[1:]:
        chosen = chosen.union(p)
    # at most 2 x rows_per_class rows, whatever the input; copies of an id meet before the shuffle
    texts = (docs.select(F.col("doc_id").cast("long").alias("_id"),
                         F.coalesce("text", F.lit("")).alias("_text"))
             .join(F.broadcast(chosen), "_id")
             .groupBy("_id", "_y", "_n").agg(F.min("_text").alias("_text")))
    run = Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id")
    kept = texts.withColumn("_to", F.sum(F.octet_length("_text").cast("long")).over(run)).where(
        F.col("_to") <= sample_bytes // 2)
    return written(kept.select("_id", "_y", "_n", "_text"), "labelled-sample")


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 6_000,
          sample_bytes: int = 256 << 20, **kw) -> str:
    """Fit on a sample (see ``labelled_sample``) of the documents whose crc32(id) mod 5 is not 0;
    the place of the fitted machine in the shared folder."""
    rows = labelled_sample(docs, labels, "toxic", 5, 0, rows_per_class, sample_bytes)

    def places(batches):
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                place, word, counts = terms(*text_buffer(part.column("_text")))
                text = np.searchsorted(np.cumsum(counts), word, "right")
                got = np.unique((text << BITS) | place) & ((1 << BITS) - 1)
                u, n = np.unique(got, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)],
                                                 names=["place", "n"])

    known = (rows.select("_text").mapInArrow(places, "place long, n long").groupBy("place")
             .agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS).select("place"))
    # at most 2^BITS places
    vocabulary = Vocabulary(known.toPandas()["place"].to_numpy(np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary = sent.value
        for batch in batches:
            for part in slices(batch, "_text"):
                win, pl, doc = windows(*vocabulary.keep(*terms(*text_buffer(
                    part.column("_text")))))
                size = np.bincount(win, minlength=len(doc)).astype("<u4")
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                cut = np.searchsorted(win, edge)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_y"), part.column("_n"),
                     pa.array([size[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])],
                              pa.binary()),
                     pa.array([pl[a:b].astype("<u4").tobytes() for a, b in
                               zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["_id", "_y", "_n", "_f", "_p"])

    bags = rows.mapInArrow(run, "_id long, _y int, _n long, _f binary, _p binary")

    def fitted(batches):
        data = {}
        for batch in batches:
            for i, y, n, f, p in zip(*[batch.column(c).to_pylist() for c in
                                       ("_id", "_y", "_n", "_f", "_p")]):
                data[i] = (np.frombuffer(f, "<u4"), np.frombuffer(p, "<u4"), y, n)
        order = sorted(data)
        y = np.array([data[i][2] for i in order], float)
        return pickle.dumps(fit(sent.value, [data[i][:2] for i in order], y,
                                sizes={v[2]: v[3] for v in data.values()}, **kw))

    place = one_blob(bags, fitted, "toxicity-model")
    sent.destroy()
    dropped(rows)
    return place


def score_documents(docs: DataFrame, machine: str, carry: tuple = ()) -> DataFrame:
    """doc_id, score, predicted of every row, with the columns in ``carry`` unchanged.
    ``machine`` is the place that ``train`` gave.

    Null and empty texts and texts without words get the score of no terms. Repeated
    rows get equal scores; null ids are kept; very long texts are scored whole, by all
    their windows; other columns are dropped unless carried, and one that clashes with
    the result's is not read; an empty table gives no row.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").alias("_text"), *[docs[c] for c in carry])
    schema = "doc_id long, score double" + "".join(
        f", `{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[2:])

    def run(batches):
        m = load_blob(machine)
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                s = m.score(*terms(*text_buffer(part.column("_text"))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(s, pa.float64()),
                     *[part.column(c) for c in carry]], names=["doc_id", "score", *carry])

    return (kept.mapInArrow(run, schema)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit and score: doc_id, held_out, score, predicted."""
    return score_documents(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
