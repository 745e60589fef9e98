import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackrank.llm import onebit
from stackrank.llm.common import open_fs, shared_folder
from stackrank.llm.sharding import assign_shards, shard_documents
from stackrank.llm.warc import (archive_pages, page_record, parse, read_archives,
                                write_archives)


def test_shards(llm, odd_docs):
    got = shard_documents(odd_docs, 5).collect()
    rows = odd_docs.collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()) + 16,
                   zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((g.doc_id or -1, g.size, g.text_crc32) for g in got) == want
    slots = {}
    for g in got:
        slots.setdefault(g.shard, []).append(g.slot)
        assert g.grown_shard in (g.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {}
    for g in got:
        assert by_id.setdefault(g.doc_id, g.shard) == g.shard
    assert shard_documents(odd_docs.limit(0)).count() == 0


def test_shards_follow_weights_and_move_little(llm):
    ids = llm.range(20_000)
    a = assign_shards(ids, "id", [1.0, 1.0, 2.0], [4.0]).collect()
    share = Counter(r.shard for r in a)
    assert abs(share[2] - 10_000) < 500 and abs(share[0] - 5_000) < 400
    moved = [r for r in a if r.grown_shard != r.shard]
    assert all(r.grown_shard == 3 for r in moved) and abs(len(moved) - 10_000) < 500
    with pytest.raises(ValueError):
        assign_shards(ids, "id", [1.0, 0.0])


def test_repeated_rows_get_slots_of_their_own(llm):
    df = llm.range(3000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"))
    got = shard_documents(df).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(3000))


BIG, OTHER = "x" * 1000, "é" * 500


@pytest.fixture(scope="module")
def pages(llm):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, "small"), (4, "u 4\r\n", "small"),
            (5, "http://a/5", None), (6, "http://a/6", ""), (7, "http://a/7", OTHER),
            (8, "http://a/8", OTHER), (8, "http://a/8", OTHER), (None, "http://a/n", BIG),
            (9, "http://a/9", "y" * 300_000), (1, "http://a/1", BIG)]
    return llm.createDataFrame([(*r, "clash", 3) for r in rows],
                               "page_id long, url string, html string, _digest string, _to int")


def brute_pages(rows):
    best = {}
    for r in rows:
        h = (r.html or "").encode()
        if len(h) >= 1000 and r.page_id is not None:
            best[h] = max(best.get(h, r.page_id), r.page_id)
    out = []
    for r in rows:
        h = (r.html or "").encode()
        to = best.get(h)
        to = None if to == r.page_id else to
        out.append((r.page_id or -1, len(h), hashlib.sha1(h).hexdigest(),
                    "response" if to is None else "revisit", to or -1))
    return sorted(out)


def test_warc_round_trip(llm, pages):
    got = archive_pages(pages, file_bytes=1500, shard_bytes=3000)
    assert sorted((g.page_id or -1, g.payload_bytes, g.payload_digest, g.record_type,
                   g.refers_to or -1) for g in got.collect()) == brute_pages(pages.collect())
    assert archive_pages(pages.limit(0)).count() == 0


def test_warc_files_are_the_same_again(llm, pages):
    def files():
        folder = shared_folder(llm, "warc-test")
        manifest = write_archives(pages, folder, file_bytes=1500, shard_bytes=3000)
        fs, root = open_fs(folder)
        names = [r.file for r in manifest.orderBy("file").collect()]
        assert read_archives(manifest, folder).count() == pages.count()
        return names, [fs.open_input_file(f"{root}/{n}").read() for n in names]
    assert files() == files()


def test_warc_records():
    h, block = parse(page_record(7, "http://x/ y", b"abc", None, None, 0, "2024-01-01T00:00:00Z"))
    assert h["WARC-Target-URI"] == "http://x/%20y" and block.endswith(b"\r\n\r\nabc")
    with pytest.raises(ValueError):
        parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")


def brute_nearest(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, set()).add(tuple(map(float, v)))
    size = Counter(len(v) for vs in ok.values() for v in vs).most_common(1)
    out = []
    for q in sorted(ok):
        if q % every == 0:
            for qv in ok[q]:
                s = [(-max(sum(a * b for a, b in zip(qv, v)) for v in vs), i)
                     for i, vs in ok.items() if i != q]
                out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(sorted(s)[:k])]
    return out if size else []


def test_nearest_is_brute_force(llm):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]              # copies, also of a query
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (420, [None] * 16),
             (None, rows[3][1]), (5, rows[5][1])]
    df = llm.createDataFrame([(*r, 1, "c") for r in rows],
                             "vec_id long, embedding array<double>, _id int, _key string")
    want = brute_nearest(rows, 20, 20)
    for blocks in (32, 8192):
        got = onebit.nearest(df, block_rows=blocks, query_rows=7).collect()
        got = sorted(tuple(r) for r in got)
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])
    assert onebit.nearest(df.limit(0)).count() == 0


def test_code_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal(64)
    rot, centre = onebit.rotation(64, 256, 1), x.mean(axis=0)
    bits, r, a = onebit.encode(x, centre, rot)
    code = (np.unpackbits(bits, axis=1) * 2.0 - 1) / 16
    est = (code @ (q @ rot)) * r / a + q @ centre
    miss = 3.5 * r * np.sqrt(1 - a * a) / a / np.sqrt(255) * np.linalg.norm(q)
    assert (np.abs(est - x @ q) <= miss).mean() > 0.999
