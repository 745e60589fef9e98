"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a budget of words: its share of all words by weight, at most
``max_epochs`` times its own size (what is above goes to the other sources by weight).
The mix takes all of a source as often as the budget allows (complete epochs); what is
left of the budget is a weighted sample without replacement: every document draws an
exponential key ``-ln(u) / quality`` and the documents with the smallest keys are taken
until their words fill the budget. The document at the edge is cut there, so a source
meets its budget to the word.

``u`` is a hash of id and text, so that reruns and other splits of the same rows agree.
No source is sorted as a whole: words are summed by (source, bucket of keys) before the
shuffle, a prefix sum over the buckets finds the one at the budget's edge, and only that
bucket's documents (some ten thousand, the number of buckets follows from the source's
rows) are put in order. Every other document is decided by comparing its key with the
edge, beside one small row per source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackrank.llm.common import numbered, same, slices, written
from stackrank.llm.wordhash import text_buffer

WEIGHTS, MAX_EPOCHS = (1, 2, 3), 3
BUCKET_ROWS = 4096                       # rows of a bucket of keys, on average
LEAST_QUALITY = 0.05

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC0:] = True                    # first bytes of characters beyond ASCII
_CHAR = ~_SPACE
_CHAR[0x80:0xC0] = False                 # later bytes of a character


def count_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of other than space and \\\\t to \\\\r), characters other than these, and
    letters (a-z, A-Z, beyond ASCII) of each text."""
    data, offs = text_buffer(col)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begin = offs[:-1][offs[:-1] < len(data)]
    first[begin] = solid[begin]

    def per_text(mask):
        return np.diff(np.searchsorted(np.flatnonzero(mask), offs))
    return per_text(first), per_text(_CHAR[data]), per_text(_LETTER[data])


def measured(docs: DataFrame, carry: tuple = (), quality: str | None = None) -> DataFrame:
    """doc_id, source, size, _key and the columns in ``carry`` of every document.

    ``quality`` names a column of positive weights; without it a document weighs by the
    share of letters among its characters. Null, NaN and lower weights count as
    ``LEAST_QUALITY``."""
    text = F.col("text")
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"),
                     F.coalesce(text, F.lit("-")))
    draw = F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("long")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"),
                       draw.alias("_draw"), text.alias("_text"),
                       (F.col(quality) if quality else F.lit(None)).cast("double").alias("_q"),
                       *[docs[c].alias(f"_carry_{c}") for c in carry])
    schema = "doc_id long, source string, _draw long, _q double, size long, _solid long, " \
             "_letters long" + "".join(f", `{f.name}` {f.dataType.simpleString()}"
                                       for f in kept.schema.fields[5:])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                size, solid, letters = count_text(part.column("_text"))
                names = ["doc_id", "source", "_draw", "_q"]
                extra = part.schema.names[5:]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], pa.array(size), pa.array(solid),
                     pa.array(letters), *[part.column(n) for n in extra]],
                    names=[*names, "size", "_solid", "_letters", *extra])

    weight = F.col("_q") if quality else F.when(
        F.col("_solid") > 0, F.col("_letters") / F.col("_solid"))
    weight = F.when(weight.isNull() | F.isnan(weight), LEAST_QUALITY).otherwise(
        F.greatest(weight, F.lit(LEAST_QUALITY)))
    return kept.mapInArrow(run, schema).select(
        "doc_id", "source", "size",
        (-F.log((F.col("_draw") + 0.5) / float(1 << 52)) / weight).alias("_key"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry])


def targets(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of ``docs`` (source, size): source, rows, source_size, target.

    The n-th source by code point (null last) has the n-th weight, repeating. A target above
    ``max_epochs`` times its source's size stops there, and the rest is shared anew among the
    others until none is above: a loop of sums over the table of sources, which is never
    collected."""
    per = written(docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"),
                                             F.sum("size").alias("source_size")), "sources")
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                        (F.col("_pos") % len(weights) + 1).cast("int"))
    table = (numbered(per, [], [F.col("source").asc_nulls_last()], "source-order")
             .withColumn("_w", pick.cast("long")).drop("_pos", "_n"))
    most = F.col("source_size") * max_epochs

    def open_share(stopped: Column) -> tuple[int, int]:
        """Words left for the sources that are not stopped, and their weight."""
        got = table.agg(F.sum(F.col("source_size") - F.when(stopped, most).otherwise(0)).alias("s"),
                        F.sum(F.when(stopped, 0).otherwise(F.col("_w"))).alias("w")).first()
        return got["s"] or 0, got["w"] or 1

    share, before = open_share(F.lit(False)), None
    while share != before:
        stopped = most < F.lit(share[0] / share[1]) * F.col("_w")
        share, before = open_share(stopped), share
    rate = F.lit(share[0] / share[1])
    return table.select("source", "rows", "source_size", F.when(
        most < rate * F.col("_w"), most.cast("double")).otherwise(rate * F.col("_w"))
        .alias("target"))


def mix(docs: DataFrame, carry: tuple = (), weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
        quality: str | None = None) -> DataFrame:
    """What the mix takes of every document: doc_id, source, size (words), source_size,
    target (words of its source in the mix), epochs (whole passes), cut (words of one more
    pass that is cut, else 0), and the columns in ``carry``.

    Null and empty texts have no words and are taken 0 words whatever their epochs; null
    sources are a source of their own, null ids a value like any other; of repeated rows
    (equal id and text) some may be taken once more than others; very long texts are one
    document, cut where the budget ends; an empty table gives no row; other columns are
    dropped unless carried.
    """
    narrow = written(measured(docs, quality=quality), "mix-measured")
    plan = targets(narrow, weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    plan = plan.withColumn("_whole", F.floor(budget / size).cast("long"))
    plan = written(plan.select(
        "*", (budget - F.col("_whole") * F.col("source_size")).alias("_rest"),
        F.greatest(F.lit(1), F.floor(F.col("rows") / BUCKET_ROWS)).cast("long").alias("_cuts")),
        "mix-plan")
    rank = F.struct("_key", "doc_id", "size")
    narrow_rank = narrow.select("source", "size", rank.alias("_rank"))
    edges = _edges(narrow_rank, plan)
    every = narrow if not carry else measured(docs, carry, quality)
    every = every.withColumn("_rank", rank)
    got = every.join(edges, same(every, edges, ["source"])).drop(edges["source"])
    at_edge = F.coalesce(F.col("_rank") == F.col("_edge"), F.lit(False))
    once_more = F.coalesce(F.col("_rank") < F.col("_edge"), F.lit(False)).cast("long")
    out = ["doc_id", "source", "size", "source_size", "target"]
    repeated = at_edge & (F.col("_copies") > 1)
    plain = got.where(~repeated).select(
        *out, (F.col("_whole") + once_more + F.when(at_edge, F.col("_full")).otherwise(0))
        .alias("epochs"), F.when(at_edge, F.col("_cut")).otherwise(F.lit(0)).alias("cut"), *carry)
    if not edges.where("_copies > 1").limit(1).count():
        return plain
    # rows that repeat the document at the edge: as many as fit are taken whole, the next is cut
    again = numbered(got.where(repeated).select(*out, "_whole", "_full", "_cut", *carry),
                     ["source"], [], "mix-repeats")
    again = again.select(
        *out, (F.col("_whole") + (F.col("_pos") < F.col("_full")).cast("long")).alias("epochs"),
        F.when(F.col("_pos") == F.col("_full"), F.col("_cut")).otherwise(F.lit(0)).alias("cut"),
        *carry)
    return plain.unionByName(again)


def _edges(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with the rank of the document at which each source's last, incomplete epoch
    ends (``_edge``, null where there is none), the rows that share it (``_copies``), how
    many of them fit (``_full``) and the words left for the next (``_cut``)."""
    # k / (1 + k) spreads the keys over (0, 1)
    key = F.col("_rank._key")
    bucket = F.floor(key / (key + 1) * F.col("_cuts")).cast("long")
    some = plan.where("_rest > 0")
    rows = (narrow.join(some, same(narrow, some, ["source"])).drop(narrow["source"])
            .withColumn("_bucket", bucket))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"),
                                                 F.max("_rest").alias("_rest"))
    run = Window.partitionBy("source").orderBy("_bucket")
    sums = sums.withColumn("_to", F.sum("_sum").over(run))
    crossing = written(sums.where("_to >= _rest AND _to - _sum < _rest")
                       .select("source", "_bucket", (F.col("_rest") - F.col("_to") + F.col("_sum"))
                               .alias("_need")), "mix-buckets")
    inside = rows.join(crossing, same(rows, crossing, ["source", "_bucket"])).select(
        rows["source"], "_rank", "size", "_need")
    # equal rows are one entry, whatever their number
    inside = inside.groupBy("source", "_rank").agg(
        F.count(F.lit(1)).alias("_copies"), F.max("size").alias("_one"),
        F.max("_need").alias("_need"))
    inside = inside.withColumn("_all", F.col("_one") * F.col("_copies"))
    inside = inside.withColumn("_to", F.sum("_all").over(
        Window.partitionBy("source").orderBy("_rank")))
    left = F.col("_need") - F.col("_to") + F.col("_all")
    edge = inside.where("_to >= _need AND _to - _all < _need").select(
        "source", F.col("_rank").alias("_edge"), "_copies",
        F.floor(left / F.col("_one")).cast("long").alias("_full"),
        (left % F.col("_one")).alias("_cut"))
    edge = written(edge, "mix-edges")
    return plan.join(edge, same(plan, edge, ["source"]), "left").drop(edge["source"])


def mixture(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: a row (doc_id, source, epoch, text) for every time that a document is
    taken, a cut one with the first words of its text. Options as for ``mix``."""
    got = mix(docs, carry=("text",), **kw)
    whole = got.where("epochs > 0").select(
        "doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), "epochs")).alias("epoch"),
        "text")

    def cut(batches):
        import re
        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            texts = []
            for t, n in zip(batch.column("text").to_pylist(), batch.column("cut").to_pylist()):
                end = next(m.end() for i, m in enumerate(word.finditer(t), 1) if i == n)
                texts.append(t[:end])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("epoch"),
                 pa.array(texts, pa.string())], names=["doc_id", "source", "epoch", "text"])

    last = got.where("cut > 0").select("doc_id", "source", (F.col("epochs") + 1).alias("epoch"),
                                       "text", "cut")
    return whole.unionByName(last.mapInArrow(
        cut, "doc_id long, source string, epoch long, text string"))


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every document,
    and the epochs and the cut they come from."""
    return mix(docs).select("doc_id", "size", "source_size", "target",
                            (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"),
                            "epochs", "cut")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS solid,
         length(regexp_replace(coalesce(text, ''), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g'))
           AS letters,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '-') || ':' || coalesce(text, '-')), 1, 13))
           ::bigint AS draw
  FROM documents),
k AS (
  SELECT *, -ln((draw + 0.5::double) / 4503599627370496::double)
            / greatest(CASE WHEN solid > 0 THEN letters::double / solid ELSE 0 END, 0.05::double)
            AS key
  FROM d),
s AS (SELECT source, sum(size)::bigint AS source_size FROM k GROUP BY source),
o AS (
  SELECT *, ((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::bigint AS w
  FROM s),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::double
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::double AS rate,
         row_number() OVER (ORDER BY 3 * source_size::double / w, source) AS n
  FROM o WINDOW before AS (ORDER BY 3 * source_size::double / w, source
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT min_by(rate, n) AS rate FROM f WHERE 3 * source_size >= rate * w),
t AS (
  SELECT source, source_size, CASE WHEN 3 * source_size < r.rate * w THEN (3 * source_size)::double
                                   ELSE r.rate * w END AS target
  FROM o, r),
b AS (
  SELECT *, floor(target + 0.5)::bigint AS budget,
         floor(floor(target + 0.5) / greatest(source_size, 1))::bigint AS whole FROM t),
c AS (
  SELECT k.doc_id, k.size, b.*, budget - whole * b.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::bigint AS size, source_size, target,
       (whole * size + least(size, greatest(0, rest - before)))::bigint AS taken,
       (whole + CASE WHEN rest > 0 AND size <= rest - before AND (size > 0 OR before < rest)
                THEN 1 ELSE 0 END)::bigint AS epochs,
       (CASE WHEN rest > before AND size > rest - before THEN rest - before ELSE 0 END)::bigint AS cut
FROM c
"""
