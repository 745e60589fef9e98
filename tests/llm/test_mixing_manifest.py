"""Mixing and Merkle manifest against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stackrank.llm import manifest, mixing
from stackrank.llm.common import numbered, table

from .test_documents import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, most=3):
    """Targets by the rule in words: cap, reshare the excess by weight, until none is above."""
    total, capped = sum(sizes), set()
    while True:
        open_w = sum(w for i, w in enumerate(weights) if i not in capped)
        left = total - sum(most * sizes[i] for i in capped)
        new = {i for i, w in enumerate(weights) if i not in capped
               and left * w > most * sizes[i] * open_w}
        if not new:
            return [most * s if i in capped else left * weights[i] / open_w
                    for i, s in enumerate(sizes)]
        capped |= new


def quality(text):
    solid = re.sub(r"[\x20\x09-\x0D]", "", text or "")
    letters = sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in solid)
    return max(0.05, letters / len(solid)) if solid else 0.05


def brute_mix(rows):
    """(id, size, source size, target, taken) of rows (id, source, text)."""
    by = defaultdict(list)
    for i, s, t in rows:
        named = f"{'-' if i is None else i}:{'-' if t is None else t}"
        u = (int(hashlib.md5(named.encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        by[s].append((-math.log(u) / quality(t), i, len(WORD.findall(t or ""))))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[2] for r in by[s]) for s in names]
    out = []
    for s, size, target in zip(names, sizes, fill(sizes, [1 + n % 3 for n in range(len(names))])):
        whole, rest = divmod(math.floor(target + 0.5), max(size, 1))
        for _, i, n in sorted(by[s], key=lambda r: r[0]):
            out.append((i if i is not None else -1, n, size, round(target, 6),
                        whole * n + min(n, rest)))
            rest -= min(n, rest)
    return sorted(out)


def taken(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.source_size,
                   round(r.target, 6), r.taken) for r in mixing.taken_words(df).collect())


def rows_of(df):
    return [(r.doc_id, r.source, r.text) for r in df.collect()]


def test_count_text():
    texts = ["", None, " a  b\n", "x y é\x1fz", "1 2-3", "\t\r\n", "a", "b"]
    size, solid, letters = mixing.count_text(pa.array(texts))
    assert size.tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert solid.tolist() == [len(re.sub(r"[\x20\x09-\x0D]", "", t or "")) for t in texts]
    assert letters.tolist() == [0, 0, 2, 5, 0, 0, 1, 1]


def test_mix_is_brute_force(llm, odd_docs):
    docs = table(llm, SF_SMALL, "documents")
    assert taken(docs.repartition(3)) == brute_mix(rows_of(docs))
    assert taken(odd_docs) == brute_mix(rows_of(odd_docs))
    assert mixing.taken_words(docs.limit(0)).count() == 0


def test_mix_of_small_sources_and_repeats(llm):
    rng = np.random.default_rng(3)
    rows = [(i, "big", " ".join(["w"] * int(rng.integers(0, 40)))) for i in range(300)]
    rows += [(7, "copies", "five words of one text")] * 90          # identical rows only
    rows += [(i, "tiny", "a b c") for i in range(5)] + [(i, None, "z " * i) for i in range(30)]
    rows += [(900, "empty", None), (901, "empty", ""), (902, "long", "q " * 5000)]
    df = llm.createDataFrame(rows, "doc_id long, source string, text string")
    got = taken(df)
    want = brute_mix(rows)
    # which of equal rows is cut is open, their number is not
    assert Counter(got) == Counter(want)
    parts = Counter()
    for r in mixing.mixture(df).collect():
        parts[r.source] += len(WORD.findall(r.text))
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(WORD.findall(t or "")) for _, x, t in rows if x == s) for s in names]
    goal = fill(sizes, [1 + n % 3 for n in range(len(names))])
    assert any(g == 3 * s > 0 for g, s in zip(goal, sizes))
    assert [parts[s] for s in names] == [math.floor(g + 0.5) for g in goal]


def test_quality_raises_the_chance(llm):
    rows = [(i, "a", " ".join(["w"] * 10), 1.0 if i % 2 else 0.1) for i in range(4000)]
    rows += [(i, "b", " ".join(["w"] * 10), 1.0) for i in range(4000, 4400)]
    df = llm.createDataFrame(rows, "doc_id long, source string, text string, q double")
    got = [r for r in mixing.mix(df, quality="q").collect() if r.source == "a"]
    good = sum(r.epochs for r in got if r.doc_id % 2)
    assert good > 0.6 * sum(r.epochs for r in got)


def test_numbered(llm):
    rng = np.random.default_rng(2)
    rows = [(None if g == 3 else f"g{g}", int(x)) for g, x in
            zip(rng.integers(0, 4, 500), rng.integers(0, 50, 500))]
    df = llm.createDataFrame(rows, "g string, x int").repartition(7)
    from pyspark.sql import functions as F
    got = defaultdict(list)
    for r in numbered(df, ["g"], [F.col("x").desc()], "t").collect():
        got[r.g].append((r._pos, r.x, r._n))
    for g, v in got.items():
        v.sort()
        xs = sorted((x for h, x in rows if h == g), reverse=True)
        assert v == [(i, x, len(xs)) for i, x in enumerate(xs)]


# Merkle manifest ------------------------------------------------------------------------

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def around(tree, at):
    for low in tree[:-1]:
        begin = at // 8 * 8
        yield "".join(low[begin:at]), "".join(low[at + 1:begin + 8])
        at //= 8


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_proofs(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: levels([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            sides = [*around(trees[g], at), *around(top, k)]
            node = leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = sha("".join(map(field, (*r[:4], r[4].translate(LOWER)))))
            for a, b in sides:
                node = sha(a + node + b)
            out.append((r[0] if r[0] is not None else -1, leaf, trees[g][-1][0], top[-1][0],
                        sha("".join(a + b for a, b in sides)), node, node == top[-1][0]))
    return sorted(out)


def proofs(df, depth=manifest.DEPTH):
    return sorted((r.doc_id if r.doc_id is not None else -1, *r[1:])
                  for r in manifest.proofs(df, depth).collect())


def fields(df):
    return [tuple(r) for r in df.select(*manifest.FIELDS).collect()]


def test_proofs_are_brute_force(llm, odd_docs):
    docs = table(llm, SF_SMALL, "documents")
    got = proofs(docs.repartition(5))
    assert got == brute_proofs(fields(docs))
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)
    assert proofs(odd_docs) == brute_proofs(fields(odd_docs))
    assert manifest.proofs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [1, 2])
def test_proofs_over_many_blocks(llm, depth):
    """Small blocks: several distributed levels, many languages, last runs of one node."""
    rows = [(i, f"s{i % 3}", f"L{(i * i) % 11 % 10}" if i % 4 else "main", i % 7 or None,
             f"Text {i} É" if i % 9 else None) for i in range(530)]
    rows += [(i, None, f"one{i}", 1, "Lone LEAF") for i in range(60)] + [rows[5]] * 3
    df = llm.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, "
                                   "text string")
    assert proofs(df, depth) == brute_proofs(rows)


def test_version_shares_untouched_nodes():
    nodes = [sha(str(i)) for i in range(100)]
    tree = manifest.Tree(nodes, manifest.height(100))
    path = tree.version(42, sha("new"))
    changed = [*nodes]
    changed[42] = sha("new")
    whole = manifest.Tree(changed, manifest.height(100))
    assert path == [lv[42 // 8 ** k] for k, lv in enumerate(whole.levels)]
    same = sum(a == b for x, y in zip(tree.levels, whole.levels) for a, b in zip(x, y))
    assert same == sum(map(len, tree.levels)) - len(path)
