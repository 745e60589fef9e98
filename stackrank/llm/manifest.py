"""Merkle manifest of a dataset, with a persistent version for every changed leaf.

A leaf is a digest of all of a row's fields. Per language the leaves ascend by id, every
``FAN`` consecutive nodes become their digest until one remains, the language's subroot;
the subroots, by language, become the root in the same way.

The tree is built in aligned blocks of ``FAN ** DEPTH`` leaves, one group of rows each: a
block's root becomes a leaf of the next, distributed table, until every language has one
node. Paths then come down the same way: a node's siblings from its block to the root.

A changed leaf makes a new *version* of the tree by copying its path: the version holds the
new digests of the leaf's ancestors and shares every other node with the original. Inside
its block the version is a few copied nodes beside the block's levels; above, it goes on
along the path that the distributed tables hand to the block. So a version costs its
ancestors, and a block of any language is bounded, whatever the number of its rows.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackrank.llm.common import numbered, written

FAN, DEPTH = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "lefts array<string>, rights array<string>"


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


class Tree:
    """Levels of digests over consecutive nodes: ``height`` times every ``FAN`` of them
    become one."""

    def __init__(self, nodes: list, height: int):
        self.levels = [nodes]
        for _ in range(height):
            low = self.levels[-1]
            self.levels.append([digest("".join(low[i:i + FAN]))
                                for i in range(0, len(low), FAN)])

    def siblings(self, at: int) -> tuple[list, list]:
        """The digests left and right of the path of node ``at``, joined, level by level."""
        lefts, rights = [], []
        for low in self.levels[:-1]:
            begin = at - at % FAN
            lefts.append("".join(low[begin:at]))
            rights.append("".join(low[at + 1:begin + FAN]))
            at //= FAN
        return lefts, rights

    def version(self, at: int, node: str) -> list:
        """Path copy: the digests of ``at`` and its ancestors when ``at`` becomes ``node``. The
        version is these nodes; all others are the tree's own."""
        path = [node]
        for low in self.levels[:-1]:
            begin = at - at % FAN
            run = low[begin:begin + FAN]
            run[at - begin] = path[-1]
            path.append(digest("".join(run)))
            at //= FAN
        return path


def upward(path: list, lefts: list, rights: list) -> list:
    """A version's path continued through upper levels, known by their siblings."""
    path = list(path)
    for a, b in zip(lefts, rights):
        path.append(digest(a + path[-1] + b))
    return path


def height(rows: int, depth: int = DEPTH) -> int:
    """Levels from ``rows`` nodes to one inside a block (a full block has ``depth``)."""
    h, n = 0, rows
    while n > 1 and h < depth:
        h, n = h + 1, -(-n // FAN)
    return h


def leaf_digest(doc_id, source, lang, n_chars, text):
    """Digest of a row's fields, each ``-`` or byte count, colon and value."""
    parts = []
    for c in (doc_id, source, lang, n_chars, text):
        v = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v),
                                F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and tampered (the digest after the text's A-Z are lower-cased, where
    3 divides crc32 of the id; else null) of every row."""
    cols = {c: F.col(c).cast("long") if c in ("doc_id", "n_chars") else F.col(c) for c in FIELDS}
    changed = F.crc32(cols["doc_id"].cast("string").cast("binary")) % 3 == 0
    lowered = {**cols, "text": F.translate(cols["text"], UPPER, LOWER)}
    return docs.select(cols["doc_id"].alias("doc_id"), cols["lang"].alias("lang"),
                       F.unhex(leaf_digest(*cols.values())).alias("leaf"),
                       F.when(changed, F.unhex(leaf_digest(*lowered.values())))
                       .alias("tampered"))


def _roots(nodes: DataFrame, depth: int) -> DataFrame:
    """Roots of the blocks of ``nodes`` (grp, _pos, _n, digest): nodes of the next table."""
    block = FAN ** depth

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        n, at = table["_n"][0].as_py(), table["_pos"][0].as_py() // block
        top = Tree(_hex(table["digest"]), height(n, depth)).levels[-1][0]
        return pa.table({"grp": table["grp"].slice(0, 1).combine_chunks(),
                         "_pos": pa.array([at], pa.int64()),
                         "_n": pa.array([-(-n // block)], pa.int64()),
                         "digest": pa.array([bytes.fromhex(top)], pa.binary())})

    return (nodes.select("grp", "_pos", "_n", "digest", _block(depth))
            .groupBy("grp", "_block").applyInArrow(
                run, "grp string, _pos long, _n long, digest binary"))


def _block(depth: int):
    return F.floor(F.col("_pos") / FAN ** depth).cast("long").alias("_block")


def _hex(column) -> list:
    return [v.hex() for v in column.to_pylist()]


def build(nodes: DataFrame, name: str, depth: int) -> list:
    """Tables of nodes from ``nodes`` (grp, _pos, _n, digest) up to the one with a single
    node per group, each made of the block roots of the one before."""
    tables = [nodes]
    while True:
        tables.append(written(_roots(tables[-1], depth), f"{name}-{len(tables)}"))
        if not tables[-1].where("_n > 1").limit(1).count():
            return tables


def _paths(nodes: DataFrame, blocks: DataFrame, depth: int) -> DataFrame:
    """grp, _pos and the path to the root of every node, from those of the blocks."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, above = left.sort_by("_pos"), right.to_pylist()[0]
        tree = Tree(_hex(left["digest"]), height(left["_n"][0].as_py(), depth))
        own = [tree.siblings(i) for i in range(len(left))]
        return pa.table({"grp": left["grp"], "_pos": left["_pos"],
                         "lefts": pa.array([a + above["lefts"] for a, _ in own],
                                           pa.list_(pa.string())),
                         "rights": pa.array([b + above["rights"] for _, b in own],
                                            pa.list_(pa.string()))})

    return (nodes.select("grp", "_pos", "_n", "digest", _block(depth)).groupBy("grp", "_block")
            .cogroup(blocks.withColumnRenamed("_pos", "_block").groupBy("grp", "_block"))
            .applyInArrow(run, f"grp string, _pos long, {PATH}"))


def descend(tables: list, tops: DataFrame, name: str, depth: int) -> DataFrame:
    """Paths to the root of the nodes of ``tables[1]``, the blocks of ``tables[0]``, given
    those of the groups' single nodes (grp, _pos, lefts, rights)."""
    paths = tops
    for i in range(len(tables) - 2, 0, -1):
        paths = written(_paths(tables[i], paths, depth), f"{name}-path-{i}")
    return paths


def manifest(docs: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree of ``docs``: its leaves (doc_id, grp, _pos, _n, digest, tampered), the paths of
    their blocks (grp, _pos, lefts, rights, subroot) and a row (root).

    Rows ascend by id, null ids first, equal ids by digest; equal rows are leaves beside each
    other. A null language is a group of its own (it comes first), as are the empty text's;
    any field may be null, and texts are hashed whole at any length. A table without rows
    has no root (null).
    """
    base = written(leaves(docs), "leaves")
    base = written(numbered(base, ["lang"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")],
                            "sorted-leaves"), "leaf-nodes")
    # the group: a mark of null, then the language
    base = base.select("doc_id", F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("grp"),
                       "_pos", "_n", F.col("leaf").alias("digest"), "tampered")
    tables = build(base, "tree", depth)
    tops = tables[-1].select(F.col("grp").alias("lang"), F.col("digest"))
    langs = written(numbered(tops, [], [F.col("lang")], "sorted-subroots"), "subroots")
    langs = langs.withColumn("grp", F.lit("root"))
    upper = build(langs.select("grp", "_pos", "_n", "digest"), "upper", depth)
    root = upper[-1].select(F.hex("digest").alias("root")).select(F.lower("root").alias("root"))
    none = F.array().cast("array<string>")
    start = upper[-1].select("grp", "_pos", none.alias("lefts"), none.alias("rights"))
    over = descend(upper, start, "upper", depth)
    subs = _paths(langs.select("grp", "_pos", "_n", "digest"), over, depth)
    at = subs.join(langs.select("_pos", "lang", "digest"), "_pos")
    at = written(at.select(F.col("lang").alias("grp"), F.lit(0).cast("long").alias("_pos"),
                           "lefts", "rights", F.lower(F.hex("digest")).alias("subroot")),
                 "subroot-paths")
    blocks = descend(tables, at.drop("subroot"), "tree", depth)
    return base, blocks.join(at.select("grp", "subroot"), "grp"), root


def versions(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, lefts and rights (joined
    sibling digests, level by level to the root), tampered (whether the row was changed) and
    ``path``: the digests that the leaf's version copies, from the (changed) leaf to the
    version's root. Rows, nulls and ties as in ``manifest``."""
    base, blocks, root = manifest(docs, depth)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, above = left.sort_by("_pos"), right.to_pylist()[0]
        nodes = _hex(left["digest"])
        tree = Tree(nodes, height(left["_n"][0].as_py(), depth))
        lefts, rights, paths, changed = [], [], [], []
        for at, new in enumerate(left["tampered"].to_pylist()):
            a, b = tree.siblings(at)
            lefts.append(a + above["lefts"])
            rights.append(b + above["rights"])
            changed.append(new is not None)
            inner = tree.version(at, new.hex() if new is not None else nodes[at])
            paths.append(upward(inner, above["lefts"], above["rights"]))
        return pa.table([left["doc_id"].combine_chunks(), pa.array(nodes),
                         pa.array([above["subroot"]] * len(nodes), pa.string()),
                         pa.array([above["root"]] * len(nodes), pa.string()),
                         pa.array(lefts, listed), pa.array(rights, listed),
                         pa.array(changed), pa.array(paths, listed)], schema=out)

    listed = pa.list_(pa.string())
    out = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()),
                     ("root", pa.string()), ("lefts", listed), ("rights", listed),
                     ("tampered", pa.bool_()), ("path", listed)])
    top = root.first()
    above = blocks.withColumnRenamed("_pos", "_block").withColumn(
        "root", F.lit(top["root"] if top else None).cast("string"))
    return (base.withColumn("_block", _block(depth)).groupBy("grp", "_block")
            .cogroup(above.groupBy("grp", "_block"))
            .applyInArrow(run, f"doc_id long, leaf string, subroot string, root string, {PATH}, "
                               "tampered boolean, path array<string>"))


def proofs(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Digests of the versions: doc_id, leaf, subroot, root, proof_sha256, folded_root and
    verified."""
    got = versions(docs, depth)
    proof = F.concat_ws("", F.transform("lefts", lambda a, i: F.concat(a, F.get("rights", i))))
    folded = F.element_at("path", -1)
    return got.select("doc_id", "leaf", "subroot", "root",
                      F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
                      folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))



# crc32 bitwise, of the reflected polynomial 0xEDB88320
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295,
      list_transform(range(1, 1 + length(doc_id::varchar)),
                     lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
f AS MATERIALIZED (
  SELECT d.doc_id, lang, coalesce(c % 3 = 0, false) AS changed,
         coalesce(strlen(d.doc_id::varchar) || ':' || d.doc_id, '-')
           || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') AS head, text
  FROM documents d LEFT JOIN crc USING (doc_id)),
l AS MATERIALIZED (
  SELECT doc_id, coalesce('+' || lang, '') AS g, leaf, tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               CASE WHEN changed THEN sha256(head || coalesce(strlen(text) || ':' || translate(text,
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
        FROM f)),
a AS (
  SELECT g, 0 AS lvl, pos, leaf AS dig, n FROM l
  UNION ALL
  SELECT g, lvl + 1, pos // 8, sha256(string_agg(dig, '' ORDER BY pos)), (n + 7) // 8
  FROM a WHERE n > 1 GROUP BY g, lvl, pos // 8, n),
s AS MATERIALIZED (
  SELECT g, dig AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n
  FROM a WHERE n = 1),
u AS (
  SELECT 0 AS lvl, pos, subroot AS dig, n FROM s
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(dig, '' ORDER BY pos)), (n + 7) // 8
  FROM u WHERE n > 1 GROUP BY lvl, pos // 8, n),
b AS MATERIALIZED (
  SELECT g, lvl, pos,
         coalesce(string_agg(dig, '') OVER (PARTITION BY g, lvl, pos // 8 ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '#'
         || coalesce(string_agg(dig, '') OVER (PARTITION BY g, lvl, pos // 8 ORDER BY pos
                     ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS sib
  FROM a WHERE n > 1),
w AS MATERIALIZED (
  SELECT lvl, pos,
         coalesce(string_agg(dig, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '#'
         || coalesce(string_agg(dig, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos
                     ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS sib
  FROM u WHERE n > 1),
p AS (
  SELECT l.g, l.pos, b.lvl AS step, b.sib FROM l JOIN b
    ON l.g = b.g AND b.pos = l.pos // (8 ** b.lvl)::bigint
  UNION ALL
  SELECT l.g, l.pos, 1000 + w.lvl, w.sib FROM l JOIN s ON l.g = s.g JOIN w
    ON w.pos = s.pos // (8 ** w.lvl)::bigint),
q AS (SELECT g, pos, list(sib ORDER BY step) AS sibs FROM p GROUP BY g, pos),
r AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT dig FROM u WHERE n = 1) AS root,
         coalesce(sibs, []) AS sibs, coalesce(l.tampered, l.leaf) AS start
  FROM l JOIN s ON l.g = s.g LEFT JOIN q ON q.g = l.g AND q.pos = l.pos)
SELECT doc_id, leaf, subroot, root,
       sha256(replace(array_to_string(sibs, ''), '#', '')) AS proof_sha256,
       list_reduce(list_prepend(start, sibs),
         lambda x, y: sha256(split_part(y, '#', 1) || x || split_part(y, '#', 2))) AS folded_root,
       folded_root = root AS verified
FROM r
"""
