"""The pipeline against a brute-force version of each stage."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stackrank.llm import pii
from stackrank.llm.common import table
from stackrank.llm.toxicity import score_documents, train

from .test_documents import SF_SMALL, brute_contamination, brute_near


def ids_by_document(pieces):
    parts = {}
    for r in pieces:
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    return {d: b"".join(x for _, x in sorted(p)) for d, p in parts.items()}


def test_run_is_brute_force(llm):
    docs = table(llm, SF_SMALL, "documents")
    model = train(docs, table(llm, SF_SMALL, "labels"))
    toxic = {r.doc_id for r in score_documents(docs, model).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    first = {d for d, c, _ in brute_near(rows) if d == c}
    rows = [r for r in rows if r[0] in first]
    bench = [(r.item_id, r.text) for r in table(llm, SF_SMALL, "benchmark").collect()]
    leaked = {d for d, _, _, _, hit in brute_contamination(rows, bench) if hit}
    rows = [r for r in rows if r[0] not in leaked]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: np.array(t.encode(pii.replace(x, {})[0], add_special_tokens=False).ids + [2],
                        "<u4").tobytes() for d, x in rows}
    assert leaked and len(first) < docs.count()
    assert ids_by_document(corpus_pipeline.run(llm, SF_SMALL).collect()) == want


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_odd_rows(llm, odd_docs, name, stage):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "_key", "score")
    got = stage(llm, docs, SF_SMALL)
    assert got.columns == corpus_pipeline.COLUMNS
    kept = got.collect()
    if name in ("decontamination", "pii"):
        assert len(kept) == docs.count()
    if name == "near_duplicates":
        texts = [r.text for r in kept]
        assert texts.count("three short words") == 1 and texts.count(None) == 2
        assert sum((t or "").startswith("alpha") for t in texts) == 1
        assert len(kept) == docs.count() - 3
    assert stage(llm, docs.limit(0), SF_SMALL).count() == 0


def test_packing_stage_on_odd_rows(llm, odd_docs):
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    got = corpus_pipeline.pack(llm, docs, SF_SMALL)
    assert sum(r.length for r in got.collect()) >= docs.count()
    assert corpus_pipeline.pack(llm, docs.limit(0), SF_SMALL).count() == 0
