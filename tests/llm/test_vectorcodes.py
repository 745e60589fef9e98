"""Vector codes against a search of all entries."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from stackrank.llm import vectorcodes as vc
from stackrank.llm.common import table

from .test_documents import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, code string, extra double"


def brute(rows, parts=4, entries=256, rounds=4):
    """Rows (vec_id, vector, label); Python integers throughout."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    x = np.array([r[1] for r in kept], object).reshape(len(kept), parts, w).astype(np.int64)
    books = x[:entries].copy()
    for n in range(rounds + 1):
        codes = np.zeros((len(kept), parts), int)
        dist = np.zeros((len(kept), parts), np.int64)
        for p in range(parts):
            for i in range(0, len(kept), 256):
                d = ((x[i:i + 256, None, p] - books[None, :, p]) ** 2).sum(axis=2)
                codes[i:i + 256, p], dist[i:i + 256, p] = d.argmin(axis=1), d.min(axis=1)
        if n < rounds:
            for p in range(parts):
                for e in set(codes[:, p].tolist()):
                    mine = x[codes[:, p] == e, p]
                    books[e, p] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    by = defaultdict(int)
    for r, d in zip(kept, dist):
        by[r[2]] += int(d.sum())
    sha = hashlib.sha256(",".join(str(v) for p in range(parts) for e in range(len(books))
                                  for v in books[e, p].tolist()).encode()).hexdigest()
    return sorted((-1 if r[0] is None else r[0], "".join(f"{c:02x}" for c in cs), int(d.sum()),
                   by[r[2]], sha) for r, cs, d in zip(kept, codes, dist))


def result(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error,
                   r.codebooks_sha256) for r in vc.vector_codes(df).collect())


def test_codes_are_brute_force(llm):
    emb = table(llm, SF_SMALL, "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in emb.collect()]
    assert result(emb.repartition(3)) == brute(rows)


def test_odd_vectors(llm):
    rng = np.random.default_rng(1)
    make = lambda: [float(v) for v in rng.integers(-3, 4, 8) / 1024]
    rows = [(i, make(), i % 3 if i % 5 else None) for i in range(700)]        # many ties
    rows += [(700, None, 1), (701, [None] * 8, 1), (702, [float("nan")] * 8, 2),
             (703, [float("inf")] * 8, 2), (None, make(), 1), (5, make(), 0)] + [rows[3]] * 90
    df = llm.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA)
    assert result(df) == brute(rows)
    assert vc.vector_codes(df.limit(0)).count() == 0
    assert vc.vector_codes(df.where("embedding IS NULL")).count() == 0
    few = [r for r in rows if r[0] is not None and r[0] < 7]
    assert result(llm.createDataFrame([(*r, "x", 0.5) for r in few], SCHEMA)) == brute(few)
    # other lengths and components that no long can hold are left out
    more = [(800, [0.5] * 3, 1), (801, [], 1), (802, [3e7] * 8, 1)]
    wide = llm.createDataFrame([(*r, "x", 0.5) for r in rows + more], SCHEMA)
    assert result(wide) == brute(rows)


@pytest.mark.parametrize("spread,b", [(3, 32), (400, 8), (1 << 24, 2)])
def test_bounds_never_miss(spread, b):
    """Entries that move at random: entries, ties and bounds stay those of a full search."""
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (900, 4))
    c = rng.integers(-spread, spread + 1, (60, 4))
    state = vc.Bounds.search(vc.Book(c), x, b)
    seen = 0
    for step in (0, 1, spread // 50, spread // 10, spread):
        new = c + rng.integers(-step, step + 1, c.shape) * (rng.random((60, 1)) < 0.5)
        drift = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)) * (1 + vc.SLACK)
        state, need = state.follow(vc.Book(new), x, drift, max(2, b - step % 3))
        c, full = new, ((x[:, None] - new) ** 2).sum(axis=2)
        assert (state.entry == full.argmin(axis=1)).all()
        rows = np.arange(len(x))
        assert (state.upper * (1 + vc.SLACK) + vc.SLACK >= np.sqrt(full[rows, state.entry])).all()
        others = np.sqrt(full.astype(float))
        assert (state.low[:, :-1] <= np.take_along_axis(others, state.near, 1) + 1e-6).all()
        others[rows, state.entry] = np.inf
        np.put_along_axis(others, state.near, np.inf, 1)
        assert (state.low[:, -1] <= others.min(axis=1) + 1e-6).all()
        seen += (need == 0).sum()
    assert seen > 900                                     # the bounds do spare comparisons


def test_number_of_bounds_adapts():
    needs = np.zeros(258, int)
    needs[[0, 1, 2, 5, 9]] = [1000, 60, 38, 1, 1]
    assert vc.adapted(32, needs) == 2 and vc.adapted(1, needs) == 1
    needs[6] = 20
    assert vc.adapted(32, needs) == 6 and vc.adapted(4, needs) == 2
