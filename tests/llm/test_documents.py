import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stackrank.llm import nearjoin, pii, quality, toxicity
from stackrank.llm.common import table
from stackrank.llm.components import components
from stackrank.llm.decontaminate import contamination, find_overlaps
from stackrank.llm.wordhash import words

SF_SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_words_match_the_pattern():
    texts = ["Hello, World", "", None, "a", "a", "É éa ÉÀ x9", "   ", "hello world", "ſ-K k"]
    h, counts = words(pa.array(texts))
    flat = [w for t in texts for w in split_words(t)]
    assert counts.tolist() == [len(split_words(t)) for t in texts]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_regular_words_do_not_collide():
    made = ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(n))
            for n in (8, 9, 16, 63, 64, 65, 1024, 4096) for k in (0, 1)]
    made += [w[:-1] + "c" for w in made] + ["c" + w[1:] for w in made]
    h, counts = words(pa.array(made))
    assert counts.tolist() == [1] * len(made) and len(set(h.tolist())) == len(set(made))
    upper, _ = words(pa.array([w.upper() for w in made]))
    assert (upper == h).all()


# near duplicates ------------------------------------------------------------------------

def shingles(text):
    w = split_words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_near(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    links = [0] * n
    for i in range(n):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and inter >= threshold * (len(sets[i]) + len(sets[j]) - inter) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0] if rows[i][0] is not None else -1,
                   low.get(find(i), -1), links[i]) for i in range(n))


def near_corpus():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(400)]
    docs = [list(rng.choice(vocab, 60)) for _ in range(40)]
    for base in docs[:4]:                                  # groups of near copies
        for _ in range(30):
            copy = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 3)):
                copy[at] = "changed"
            docs.append(copy)
    shared = list(rng.choice(vocab, 50))                   # a passage many documents hold
    docs += [shared + list(rng.choice(vocab, 40)) for _ in range(40)]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("bucket,verify,ids", [(1024, 1 << 19, 2_000_000), (7, 6000, 0)])
def test_near_duplicates_are_brute_force(llm, monkeypatch, bucket, verify, ids):
    monkeypatch.setattr(nearjoin, "BROADCAST_IDS", ids)       # hashes sent, and texts shuffled
    rows = near_corpus()
    df = llm.createDataFrame(rows, "doc_id long, text string")
    got = nearjoin.near_duplicates(df, bucket_chunk=bucket, verify_chunk=verify).collect()
    assert sorted((g.doc_id, g.class_id, g.n_links) for g in got) == brute_near(rows)
    assert Counter(g.class_id for g in got if g._first) == Counter({g.class_id for g in got})


def test_near_duplicates_odd_rows(llm, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = nearjoin.near_duplicates(odd_docs).collect()
    assert sorted((g.doc_id if g.doc_id is not None else -1,
                   g.class_id if g.class_id is not None else -1, g.n_links)
                  for g in got) == brute_near(rows)
    assert nearjoin.near_duplicates(odd_docs.limit(0)).count() == 0


def test_pruning_bound_is_the_posterior():
    rng = np.random.default_rng(5)
    for n in (36, 252):
        m = nearjoin.least_matches(n, 0.8, 1e-3)
        draws = rng.beta(m + 1, n - m + 1, 400_000)
        assert (draws >= 0.8).mean() == pytest.approx(1e-3, rel=2.0)
        assert (rng.beta(m - 2, n - m + 4, 400_000) >= 0.8).mean() < 1e-3


def test_components(llm):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)] + [
        (300, 300 + i) for i in range(1, 40)]
    got = dict(components(llm.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(1, 51)} | {200: 100, 150: 100} | {
        300 + i: 300 for i in range(1, 40)}
    assert got == want
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


# benchmark decontamination --------------------------------------------------------------

def brute_contamination(docs, bench):
    wins = [(i, w[k:k + min(len(w), 10)]) for i, t in bench if (w := split_words(t))
            for k in range(max(1, len(w) - 9))]
    out = []
    for d, t in docs:
        w = split_words(t)
        hit, items = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k:k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    if i is not None:
                        items.add(i)
        out.append((d if d is not None else -1, len(w), len(hit), len(items), bool(hit)))
    return sorted(out)


def test_contamination_is_brute_force(llm):
    rng = np.random.default_rng(6)
    vocab = ["a", "b", "C", "é"]                           # few words: many chance overlaps
    make = lambda n: " ".join(rng.choice(vocab, n))
    bench = [(i, make(n)) for i, n in enumerate([10, 12, 25, 9, 3, 1, 11])] + [
        (7, None), (8, ""), (None, make(10)), (2, make(14)), (9, "zz yy")]
    docs = [(i, make(rng.integers(0, 300))) for i in range(60)]
    docs += [(100 + i, f"{make(5)} {bench[2][1].upper()} {make(5)}") for i in range(3)]
    docs += [(200, "a " * 500), (201, None), (201, ""), (None, bench[0][1]), (202, "yy zz yy")]
    d = llm.createDataFrame([(*r, 1, "x") for r in docs],
                            "doc_id long, text string, item_id int, items string")
    b = llm.createDataFrame([(*r, 1) for r in bench], "item_id long, text string, doc_id int")
    got = sorted((g.doc_id if g.doc_id is not None else -1, g.n_words, g.n_hit, g.n_items,
                  g.contaminated) for g in contamination(d, b).collect())
    assert got == brute_contamination(docs, bench)
    assert contamination(d.limit(0), b).count() == 0
    none = contamination(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


def test_contamination_with_several_index_files(llm, monkeypatch):
    from stackrank.llm import decontaminate
    d, b = table(llm, SF_SMALL, "documents"), table(llm, SF_SMALL, "benchmark")
    one = sorted(map(str, find_overlaps(d, b).collect()))
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)
    assert sorted(map(str, find_overlaps(d, b).collect())) == one


# personal data --------------------------------------------------------------------------

TEXT = ("Write to el.01@mail8.example.com or EL.01@MAIL8.EXAMPLE.COM, bob_x@corp.co.uk; call "
        "+1 (696) 555-2293, +1 696 555 2293 or (415) 555-1234. Hosts 175.102.247.55, "
        "192.168.1.20. Cards 4111 1111 1111 1111 and 4952935900253053. SSN 123-45-6789. "
        "Mr. John Smith and Mrs. Smith met Frau Müller, Anna Petrova and Иван Петров.")
CLEAN = "Version 2.0 of 2024-01-01, 12345 items, CC BY-NC 4.0, 1.2.3, a@b, x 999 y. The Anna river."


def test_surrogates_keep_type_and_format():
    out, kinds, ents, subs = pii.replace(TEXT, {})
    assert Counter(kinds) == {"email": 3, "phone": 3, "ip": 2, "card": 2, "ssn": 1, "name": 5}
    for e, s in zip(ents, subs):
        assert e not in out and len(e) == len(s) or e.split()[0] in pii._GIVEN_OF
    assert re.sub(r"\w", "", out) == re.sub(r"\w", "", TEXT)
    got = dict(zip(ents, subs))
    assert pii.luhn(got["4111111111111111"]) == 0 != pii.luhn(got["4952935900253053"])
    assert got["192.168.1.20"].startswith("192.168.")
    assert pii.find(out) and [k for _, _, k in pii.find(out)] == kinds
    given, surname = got["Анна Петрова" if "Анна Петрова" in got else "Иван Петров"].split()
    assert given in pii.GIVEN[("m", "cyrillic")] and all("а" <= c.lower() <= "ё" for c in surname)
    assert got["Anna Petrova"].split()[0] in pii.GIVEN[("f", "latin")]
    assert got["John Smith"].split()[1] == got["Smith"]      # coreference of the surname
    assert pii.replace(CLEAN, {})[0] == CLEAN


FORMS = {"email": ("_john@x.com_", "-john@x.com", "john@x.com_", "john@x.com--call", "john.@x.com",
                   "hans@müller.de", "mail 王小明@x.com的"),
         "phone": ("+33 6 12 34 56 78", "(+33) 6 12 34 56 78", "555 123 4567", "030 1234567",
                   "06 12 34 56 78", "06\u00a012\u00a034\u00a056\u00a078", "(030) 1234567",
                   "0033 6 12 34 56 78", "+44 (0)20 7946 0958", "8 (495) 123-45-67",
                   "(11) 91234-5678", "138 1234 5678", "555-123-4567--call", "_555-123-4567_"),
         "ip": ("152.143.123.131.Then", "Server.152.143.123.131", "_192.168.1.20_"),
         "ssn": ("_123-45-6789_",), "card": ("_4111 1111 1111 1111_",), "name": ("_John Smith_",)}
NO_FORMS = ("01/02/2023 10:30", "01.02.2023 10:30", "1.2.3.4.5", "0123456789", "ABC-123-456-7890",
            "ISBN 0-306-40615-2", "123-456-7890-12", "123 456 789 items", "10 000 000 000")


def test_common_forms_are_found_and_keep_their_layout():
    for kind, forms in FORMS.items():
        for text in forms:
            out, kinds, ents, subs = pii.replace(text, {})
            assert kinds == [kind] and ents[0] != subs[0] and out != text, text
            assert [k for _, _, k in pii.find(out)] == kinds, (text, out)
            assert re.sub(r"\w", "", out) == re.sub(r"\w", "", text)
    for text in NO_FORMS:
        assert pii.find(text) == [], text
    # equal numbers in other layouts are one entity; what follows a number is not part of it
    two = "+33 6 12 34 56 78 24 hours, +33612345678 06 12 34 56 78 4111 1111 1111 1111"
    _, kinds, ents, _ = pii.replace(two, {})
    assert kinds == ["phone", "phone", "phone", "card"] and ents[0] == ents[1] == "+33612345678"


def test_letters_outside_the_alphabets_have_stand_ins():
    users = [a + b for a in "王李张刘陈" for b in "小明伟芳"] + ["ß", "ʼn", "김철수", "łukasz", "علي"]
    subs = [pii.surrogate("email", f"{u}@x.com").split("@")[0] for u in users]
    assert len(set(subs)) == len(users) and not set(subs) & set(users)
    assert pii.surrogate("email", "ß@x.com", 0, b"other").split("@")[0] != subs[20]


def test_surrogates_are_permutations():
    assert len({pii.permute_text(f"{i:04d}", pii.KEY, b"t") for i in range(10_000)}) == 10_000
    cards = [f"4{i:03d}000000000000" for i in range(1000)]
    assert len({pii.surrogate("card", c) for c in cards}) == 1000
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(3000)]
    assert len({pii.surrogate("ip", x) for x in ips}) == 3000
    mails = [f"{u}@{d}.org" for u in ("ab", "cd", "xy") for d in ("foo", "bar")]
    subs = [pii.surrogate("email", m) for m in mails]
    assert len(set(subs)) == 6 and len({s.split("@")[1] for s in subs}) == 2


def test_surrogates_that_meet_entities_are_drawn_again(llm):
    a = "175.102.247.55"
    b = pii.surrogate("ip", a)                              # another real address
    df = llm.createDataFrame([(1, f"from {a}"), (2, f"to {b} and {a}"), (3, None), (4, "")],
                             "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_pii(df).collect()}
    assert got[3].text is None and got[4].text == "" and got[3].n_entities == 0
    new_a = got[1].text.split()[1]
    assert new_a not in (a, b) and got[2].text.split()[3] == new_a
    assert got[2].text.split()[1] not in (a, b, new_a)


def test_full_formats_are_widened_or_an_error(llm):
    """All one-letter users of a domain: no surrogate of their format is free."""
    mails = [f"{c}@foo.org" for c in pii.LOWER] + [
        pii.surrogate("email", "a@foo.org").replace("@", "q@")]
    mails += [f"{c}@{mails[-1].split('@')[1]}" for c in pii.LOWER]
    df = llm.createDataFrame([(i, f"to {m} now") for i, m in enumerate(mails)],
                             "doc_id long, text string")
    got = [r.text.split()[1] for r in pii.replace_pii(df).collect()]
    assert len(set(got)) == len(mails) and not set(got) & set(mails)
    found = pii.entities(df.selectExpr("doc_id AS _rid", "text AS _text"))
    with pytest.raises(ValueError, match="entities left: {'email': "):
        pii.redraw(found, rounds=2)
    assert pii.surrogate("ip", "192.168.1.20", pii.WIDER).startswith("10.")
    assert re.fullmatch("[А-ЯЁ][а-яё]{7}", pii.surrogate("name", "Ли", pii.WIDER))
    assert pii.find("Mr " + pii.surrogate("name", "Li", pii.WIDER))


def test_surrogates_over_the_corpus(llm, odd_docs):
    docs = table(llm, SF_SMALL, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    pairs, back = {}, {}
    for r in pii.replace_pii(docs).collect():
        found = [(k, pii.canonical(k, before[r.doc_id][s:e]))
                 for s, e, k in pii.find(before[r.doc_id])]
        after = [(k, pii.canonical(k, r.text[s:e])) for s, e, k in pii.find(r.text)]
        assert [k for k, _ in found] == [k for k, _ in after] == r.kinds
        if not found:
            assert r.text == before[r.doc_id]
        for x, y in zip(found, after):
            assert pairs.setdefault(x, y) == y and back.setdefault(y, x) == x
    assert pairs and not set(pairs) & set(back)
    odd = pii.replace_pii(odd_docs)
    assert odd.count() == odd_docs.count() and pii.replace_pii(odd_docs.limit(0)).count() == 0


# classifiers ----------------------------------------------------------------------------

def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_machine_learns_a_pair():
    """Each of two words is toxic alone and harmless beside the other: no sum of weights
    can tell, the vectors can."""
    rng = np.random.default_rng(8)
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        filler = [f"f{i}" for i in rng.integers(0, 300, 12)]
        texts.append(" ".join(filler + ["mention"] * a + ["slur"] * b))
        y.append(int(a != b))
    terms = toxicity.terms(*toxicity.text_buffer(pa.array(texts)))
    vocabulary = toxicity.Vocabulary(np.unique(terms[0]))
    win, place, doc = toxicity.windows(*vocabulary.keep(*terms))
    e = np.searchsorted(doc, np.arange(len(texts) + 1))
    c = np.searchsorted(win, e)
    size = np.bincount(win, minlength=len(doc))
    docs = [(size[e[i]:e[i + 1]], place[c[i]:c[i + 1]]) for i in range(len(texts))]
    made = {r: toxicity.fit(vocabulary, docs, np.array(y, float), epochs=30, pair_rate=r,
                            lift=0.5) for r in (0.1, 0.0)}
    one = lambda t, r: float(made[r].score(
        *toxicity.terms(*toxicity.text_buffer(pa.array([t]))))[0])
    both, single = "f1 f2 mention slur f3", ("f1 mention f3", "f2 slur f9")
    assert one(both, 0.1) < 0.3 < 0.5 < min(one(t, 0.1) for t in single)
    assert max(abs(one(t, 0.0) - 0.5) for t in (both, *single)) < 0.15


def test_attention_gradient():
    rng = np.random.default_rng(9)
    m = quality.Bags(1)
    x, per = rng.standard_normal((9, quality.FEATURES)), np.array([4, 1, 4])
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)
    grad = m.gradient(x, per, y, w)

    def loss():
        s, _ = m.forward(x, per)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum()
    for name in m.p:
        at = tuple(rng.integers(0, n) for n in m.p[name].shape)
        keep = m.p[name][at]
        m.p[name][at] = keep + 1e-5
        up = loss()
        m.p[name][at] = keep - 1e-5
        down = loss()
        m.p[name][at] = keep
        assert (up - down) / 2e-5 == pytest.approx(grad[name][at], abs=1e-4)


@pytest.mark.parametrize("name,label,fn,least", [
    ("toxicity", "toxic", toxicity.toxicity, 0.85), ("quality", "quality", quality.quality, 0.97)])
def test_held_out_ranking(llm, name, label, fn, least):
    sf = "/root/testdata/sf0.1"
    got = fn(table(llm, sf, "documents"), table(llm, sf, "labels"))
    rows = got.join(table(llm, sf, "labels"), "doc_id").where("held_out").collect()
    s, y = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    assert auc(s, y) >= least
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


@pytest.mark.parametrize("fn", [toxicity.toxicity, quality.quality])
def test_classifiers_on_odd_rows(llm, odd_docs, fn):
    labels = llm.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, 1), (6, None, None), (None, 1, 1),
                                  (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = fn(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert fn(odd_docs.limit(0), labels).count() == 0
    assert fn(odd_docs, labels.limit(0)).count() == odd_docs.count()
