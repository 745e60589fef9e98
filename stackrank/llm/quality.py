"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of 400 bytes (its whole text). Every passage is
encoded from byte statistics, byte pairs and how often its words and word runs
repeat; a hidden layer follows. Gated attention gives each passage a weight,
``softmax(w (tanh(V h) * sigmoid(U h)))`` over the document's passages, and the weighted
sum of the encodings is scored by a logistic unit. Only document labels are used;
the weights show which passages decided.

The model has about 10,000 numbers and is fitted in one task on a bounded sample of labelled
rows (at most ``rows_per_class`` of each class and ``sample_bytes`` of text, those with the
lowest hash of their id).
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackrank.llm.common import dropped, load_blob, one_blob, slices
from stackrank.llm.toxicity import held_out, labelled_sample
from stackrank.llm.wordhash import grams, text_buffer, word_spans, words

PASSAGE, PAIRS, HIDDEN, ATTENTION = 400, 64, 32, 16
_KIND = np.full(256, 11, np.uint8)                      # other symbols
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                             b"0123456789", b" ", b"\n\r\t", b".", b",", b"!?", b"'\"-:;()",
                             b"#$%&*@^~=+_<>", b"|\\/[]{}")):
    _KIND[list(_chars)] = _i
_KIND[128:] = 12
KINDS = 13
FEATURES = KINDS + PAIRS + 6


def passages(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text). An empty text is one
    passage without bytes."""
    data, offs = text_buffer(col)
    size = np.diff(offs)
    per = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(per) - per
    n = int(per.sum())
    doc = np.repeat(np.arange(len(size)), size)
    at = (np.arange(len(data)) - offs[:-1][doc]) // PASSAGE + first[doc]
    x = np.zeros((n, FEATURES), np.float32)
    length = np.bincount(at, minlength=n)
    safe = np.maximum(length, 1)[:, None]
    kind = _KIND[data].astype(np.int64)
    x[:, :KINDS] = np.bincount(at * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS) / safe
    if len(data) > 1:
        same = at[1:] == at[:-1]
        pair = (kind[:-1] * KINDS + kind[1:]) % PAIRS
        x[:, KINDS:KINDS + PAIRS] = np.bincount(
            at[1:][same] * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS) / safe
    h, counts = words(col)
    starts, ends = word_spans(data, offs)
    c = KINDS + PAIRS
    if len(h):
        where = at[starts]
        total = np.bincount(where, minlength=n)
        key = np.unique(np.stack([where.astype(np.uint64), h], 1), axis=0)
        distinct = np.bincount(key[:, 0].astype(np.int64), minlength=n)
        some = np.maximum(total, 1)
        x[:, c] = distinct / some
        x[:, c + 1] = np.bincount(where, weights=ends - starts, minlength=n) / some / 10
        text = np.repeat(np.arange(len(counts)), counts)
        x[:, c + 2] = _repeats(h, text, where, n) / some
        g = grams(h, 3)
        if len(g):
            ok = np.flatnonzero(text[:len(g)] == text[2:])
            x[:, c + 3] = _repeats(g[ok], text[ok], where[ok], n) / some
    x[:, c + 4] = np.log1p(length) / 6
    x[:, c + 5] = (np.log1p(size) / 12)[np.repeat(np.arange(len(size)), per)]
    return x, per


def _repeats(h, text, where, n):
    """How many values of each passage occur more than once in their text."""
    order = np.lexsort((h, text))
    a, b = h[order], text[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    rep = np.zeros(len(h), bool)
    rep[order[1:][same]] = True
    rep[order[:-1][same]] = True
    return np.bincount(where[rep], minlength=n)


class Bags:
    """Gated attention over passages; parameters in ``p``."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda a, b: r.standard_normal((a, b)) * np.sqrt(2 / a)
        self.mean, self.std = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {"w1": f(FEATURES, HIDDEN), "b1": np.zeros(HIDDEN), "v": f(HIDDEN, ATTENTION),
                  "u": f(HIDDEN, ATTENTION), "w": f(ATTENTION, 1)[:, 0],
                  "c": f(HIDDEN, 1)[:, 0], "b": np.zeros(1)}

    def forward(self, x, per):
        p = self.p
        x = np.clip((x - self.mean) / self.std, -8, 8)
        first = np.cumsum(per) - per
        doc = np.repeat(np.arange(len(per)), per)
        h = np.maximum(x @ p["w1"] + p["b1"], 0)
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[doc])
        a = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
        return s, (x, first, doc, h, t, g, a, z)

    def score(self, x, per) -> tuple[np.ndarray, np.ndarray]:
        """(score of each text, attention of each passage)."""
        if not len(per):
            return np.zeros(0), np.zeros(0)
        s, state = self.forward(x.astype(np.float64), per)
        return s, state[6]

    def gradient(self, x, per, y, weight):
        p = self.p
        s, (x, first, doc, h, t, g, a, z) = self.forward(x, per)
        ds = (s - y) * weight
        dz = ds[:, None] * p["c"]
        dh = a[:, None] * dz[doc]
        da = (h * dz[doc]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first)[doc])
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh += dt @ p["v"].T + dg @ p["u"].T
        dh *= h > 0
        return {"w1": x.T @ dh, "b1": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg,
                "w": (t * g).T @ de, "c": z.T @ ds, "b": np.array([ds.sum()])}


def fit(bags: list, labels: np.ndarray, sizes: dict | None = None, epochs: int = 12,
        rate: float = 3e-3, decay: float = 1e-4, batch: int = 64, seed: int = 3) -> Bags:
    """Fit by Adam on the log loss of document labels; ``sizes`` are the classes' sizes where
    the bags are a sample of each class."""
    m = Bags(seed)
    if not len(labels) or labels.min() == labels.max():
        m.p["c"] = np.zeros(HIDDEN)
        m.p["b"] = np.array([4.0 if len(labels) and labels[0] else -4.0])
        return m
    everything = np.concatenate(bags)
    m.mean, m.std = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    share = np.array([(labels == c).mean() for c in (0, 1)])
    whole = np.array([sizes[0], sizes[1]], float) if sizes else share
    each = np.sqrt(whole / whole.sum())
    weight = (each / each.sum() / share)[labels.astype(int)]
    rng = np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in m.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in m.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        lr = rate * (1 - epoch / epochs)
        for lo in range(0, len(order), batch):
            part = order[lo:lo + batch]
            x = np.concatenate([bags[i] for i in part]).astype(np.float64)
            per = np.array([len(bags[i]) for i in part])
            grad = m.gradient(x, per, labels[part], weight[part] / len(part))
            step += 1
            for k, g in grad.items():
                g = g + decay * m.p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                m.p[k] = m.p[k] - lr * (m1[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return m


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4_000,
          sample_bytes: int = 256 << 20, **kw) -> str:
    """Fit in one task on a sample (see ``labelled_sample``) of the documents whose crc32(id)
    mod 3 is not 1; the place of the fitted model in the shared folder."""
    rows = labelled_sample(docs, labels, "quality", 3, 1, rows_per_class, sample_bytes)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                x, per = passages(part.column("_text"))
                cut = np.cumsum(per)
                out = [x[e - k:e].astype("<f4").tobytes() for e, k in zip(cut, per)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_y"), part.column("_n"),
                     pa.array(out, pa.binary())], names=["_id", "_y", "_n", "_f"])

    def fitted(batches):
        data = {}
        for batch in batches:
            for i, y, n, f in zip(*[batch.column(c).to_pylist() for c in
                                    ("_id", "_y", "_n", "_f")]):
                data[i] = (np.frombuffer(f, "<f4").reshape(-1, FEATURES), y, n)
        order = sorted(data)
        return pickle.dumps(fit([data[i][0] for i in order],
                                np.array([data[i][1] for i in order], float),
                                {y: n for _, y, n in data.values()}, **kw))

    place = one_blob(rows.mapInArrow(run, "_id long, _y int, _n long, _f binary"), fitted,
                     "quality-model")
    dropped(rows)
    return place


def score_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, score, predicted, n_passages, top_passage (byte offset of the passage with the
    largest attention) of every row. ``model`` is the place that ``train`` gave.

    Null and empty texts are one empty passage; very long texts are scored by all passages; repeated rows get equal scores; null ids
    are kept; other columns are ignored; an empty table gives no row.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").alias("_text"))

    def run(batches):
        m = load_blob(model)
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                x, per = passages(part.column("_text"))
                s, a = m.score(x, per)
                end = np.cumsum(per)
                top = [int(np.argmax(a[e - k:e])) * PASSAGE for e, k in zip(end, per)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(s, pa.float64()),
                     pa.array(per, pa.int64()), pa.array(top, pa.int64())],
                    names=["doc_id", "score", "n_passages", "top_passage"])

    out = kept.mapInArrow(run, "doc_id long, score double, n_passages long, top_passage long")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit and score: doc_id, held_out, score, predicted, n_passages, top_passage."""
    return score_documents(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted",
        "n_passages", "top_passage")
