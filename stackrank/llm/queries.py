"""The dealt queries opN_<name> and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stackrank.llm.common import prepare, table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@_query("op1_simple8b")
def op1(spark, sf_dir):
    """Documents as Simple-8b id files, read back."""
    from stackrank.llm.simple8b import token_files
    return token_files(table(spark, sf_dir, "documents"),
                       public_tokenizers.path("byte_bpe_50k.json"))


@_query("op4_packing")
def op4(spark, sf_dir):
    """Documents packed into sequences of 4096 ids."""
    from stackrank.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def _op10_sql():
    from stackrank.llm.decontaminate import ORACLE
    return ORACLE


@_query("op10_winnowing", oracle=_op10_sql())
def op10(spark, sf_dir):
    """Every document against every benchmark item, by winnowed fingerprints."""
    from stackrank.llm.decontaminate import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op6_sql():
    from stackrank.llm.sharding import ORACLE
    return ORACLE


@_query("op6_rendezvous", oracle=_op6_sql())
def op6(spark, sf_dir):
    """Documents over 40 equal shards by rendezvous hashing of doc_id."""
    from stackrank.llm.sharding import shard_documents
    return shard_documents(table(spark, sf_dir, "documents"), 40)


def _op8_sql():
    from stackrank.llm.warc import ORACLE
    return ORACLE


@_query("op8_warc", oracle=_op8_sql())
def op8(spark, sf_dir):
    """Pages as WARC archives, read back."""
    from stackrank.llm.warc import archive_pages
    return archive_pages(table(spark, sf_dir, "pages"))


def _op5_sql():
    from stackrank.llm.onebit import ORACLE
    return ORACLE


@_query("op5_onebit", oracle=_op5_sql())
def op5(spark, sf_dir):
    """The 20 nearest of every 20th embedding, by rotated one-bit codes and reranking."""
    from stackrank.llm.onebit import nearest
    return nearest(table(spark, sf_dir, "embeddings"))


def _op3_sql():
    from stackrank.llm.nearjoin import ORACLE
    return ORACLE


@_query("op3_jaccard_join", oracle=_op3_sql())
def op3(spark, sf_dir):
    """Documents with a Jaccard similarity of 0.8 or more on five-word shingles."""
    from stackrank.llm.nearjoin import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).drop("_rid", "_first")


@_query("op2_surrogates")
def op2(spark, sf_dir):
    """Documents with personal data replaced by surrogates."""
    from stackrank.llm.pii import replace_pii
    return replace_pii(table(spark, sf_dir, "documents"))


@_query("op7_factorization")
def op7(spark, sf_dir):
    """Toxicity of every document."""
    from stackrank.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op9_attention")
def op9(spark, sf_dir):
    """Quality of every document."""
    from stackrank.llm.quality import quality
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op11_sql():
    from stackrank.llm.mixing import ORACLE
    return ORACLE


@_query("op11_mixture", oracle=_op11_sql())
def op11(spark, sf_dir):
    """Words of every document that the mix of all sources takes."""
    from stackrank.llm.mixing import taken_words
    return taken_words(table(spark, sf_dir, "documents"))


def _op12_sql():
    from stackrank.llm.manifest import ORACLE
    return ORACLE


@_query("op12_merkle", oracle=_op12_sql())
def op12(spark, sf_dir):
    """Merkle manifest of all documents, with the version of every changed one."""
    from stackrank.llm.manifest import proofs
    return proofs(table(spark, sf_dir, "documents"))


def _op13_sql():
    from stackrank.llm.vectorcodes import ORACLE
    return ORACLE


@_query("op13_vectorcodes", oracle=_op13_sql())
def op13(spark, sf_dir):
    """Embeddings as four-byte codes, trained with adaptive distance bounds."""
    from stackrank.llm.vectorcodes import vector_codes
    return vector_codes(table(spark, sf_dir, "embeddings"))
