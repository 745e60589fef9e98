import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stackrank.llm import simple8b as s8
from stackrank.llm.packing import (TournamentTree, first_fit_decreasing, pack_documents,
                                   pack_lengths)
from stackrank.llm.tokens import PieceEncoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENC = {f: PieceEncoder(public_tokenizers.path(f), max_pieces=50) for f in FILES}


def whole(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def split(enc, texts):
    ids, lens = enc.encode(texts)
    ends = np.cumsum(lens)
    return [ids[e - n:e].tolist() for n, e in zip(lens, ends)]


ALPHABET = st.sampled_from(list("ab'sZ9.,!<|>é́ŉ中ß \n\t\x00\x1f  ") + ["  ", " \n", "<|endoftext|>", "<|startoftext|>", "<|"])


@pytest.mark.parametrize("name", FILES)
@given(st.lists(st.lists(ALPHABET, max_size=12).map("".join), max_size=4))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(name, texts):
    assert split(ENC[name], texts) == whole(name, texts)


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("name", FILES)
def test_added_tokens_and_like_words(name):
    """Added tokens have ids of their own; long words that differ in a regular way are told
    apart, also when the one is known already."""
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<| no token |>", "a<|b", "<|"]
    assert split(ENC[name], texts) == whole(name, texts)
    assert 50256 in split(ENC[FILES[0]], texts)[0] and 49407 in split(ENC[FILES[1]], texts)[0]
    long = [thue_morse(n, *ab) for n in (8, 16, 64, 1024, 2048) for ab in ("ab", "ba")]
    enc = PieceEncoder(public_tokenizers.path(name))
    for t in long:
        assert split(enc, [t]) == whole(name, [t])
    assert split(enc, long) == whole(name, long)


@pytest.mark.parametrize("name", FILES)
def test_pieces_on_documents(llm, name):
    texts = [r[0] for r in llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
             .select("text").collect()]
    assert split(ENC[name], texts) == whole(name, texts)


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)),
                max_size=300), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_simple8b_round_trip(values, times):
    v = np.array(values * times, np.uint64)
    words, counts = s8.encode_blocks(v)
    assert counts.sum() == len(words)
    assert (s8.decode_blocks(words, counts, len(v)) == v).all()


def test_simple8b_is_compact():
    v = np.random.default_rng(0).integers(0, 1 << 15, 40_960).astype(np.uint64)
    assert 8 * len(s8.encode_blocks(v)[0]) <= 2 * len(v) + 100


def expected_tokens(rows, name):
    ids = whole(name, [t or "" for _, t in rows])
    return [np.array(x + [2], "<u4") for x in ids]


def test_token_files(llm, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [tuple(r) for r in s8.token_files(
        odd_docs, public_tokenizers.path(FILES[0]), shard_bytes=4000).orderBy("start").collect()]
    want = sorted((r[0] is not None, r[0] or 0, len(x), zlib.crc32(x.tobytes()))
                  for r, x in zip(rows, expected_tokens(rows, FILES[0])))
    assert sorted((g[0] is not None, g[0] or 0, g[2], g[3]) for g in got) == want
    assert [g[0] or 0 for g in got] == sorted(g[0] or 0 for g in got)
    assert [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    empty = s8.token_files(odd_docs.limit(0), public_tokenizers.path(FILES[0]))
    assert empty.count() == 0


def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 400)
    bins, offset = first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(100)
        want[i] = (b, 100 - room[b])
        room[b] -= lengths[i]
    assert {i: (b, o) for i, (b, o) in enumerate(zip(bins, offset))} == want
    tree = TournamentTree(1, 5)
    assert tree.first_fit(5) == 0


@given(st.lists(st.integers(1, 300), max_size=40))
@settings(max_examples=100, deadline=None)
def test_pieces_cover_items_and_sequences(lengths):
    pieces = pack_lengths(np.array(lengths, np.int64), 64, 4)
    by_item, by_seq = {}, {}
    for i, start, n, s, off in pieces:
        by_item.setdefault(i, []).append((start, n))
        by_seq.setdefault(s, []).append((off, n))
    for parts, total in [(by_item[i], n) for i, n in enumerate(lengths)]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == total
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 64 and (64 - at <= 4 or at & (at - 1) == 0)


def test_packing(llm, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = pack_documents(odd_docs, public_tokenizers.path(FILES[1]), group_ids=20_000).collect()
    want = {}
    for (i, _), x in zip(rows, expected_tokens(rows, FILES[1])):
        want.setdefault(i, []).append(x.tobytes())
    per_doc = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        per_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for (i, _), parts in per_doc.items():
        copies = [x for x in want[i] if len(x) == 4 * _]
        assert b"".join(p for _, p in sorted(parts)) and sum(map(len, copies)) == sum(
            len(p) for _, p in parts)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
    for parts in seqs.values():
        assert sum(n for _, n, _ in parts) == parts[0][2] <= 4096
        assert [o for o, _, _ in sorted(parts)] == [
            0, *np.cumsum([n for _, n, _ in sorted(parts)])[:-1].tolist()]
    assert pack_documents(odd_docs.limit(0), public_tokenizers.path(FILES[1])).count() == 0
