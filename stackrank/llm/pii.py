"""Surrogates for personal data.

E-mail addresses, telephone numbers, IPv4 addresses, payment card numbers, social
security numbers and names are found by pattern and replaced by keyed surrogates of the
same type and format. Equal entities get equal surrogates everywhere (coreference) and
different ones different surrogates (distinctness):

* A surrogate comes from a keyed permutation of all strings of the entity's format
  (a Feistel network over mixed digits: each position keeps its alphabet, so letter
  case, script, digits and punctuation stay). A permutation cannot map two entities of
  a format to one surrogate, and walking along it until the result is valid for the
  type (card check digit, address class, area code) keeps that.
* Names are permuted inside lists of their gender and script.
* A first pass over the corpus gathers the distinct entities; where a surrogate is
  itself an entity of the corpus, or two meet, the entity with the larger text
  draws again under the next attempt number until nothing meets. The few entities with
  a higher attempt are joined to the documents that hold them; the rest needs no table.
* A format may be too full for that (one-letter user names of a domain, two-letter
  surnames, 192.168.0.0/16). From attempt ``WIDER`` on user names and surnames are drawn
  longer and private addresses in 10.0.0.0/8; if entities still meet, it is an error.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackrank.llm.common import slices, written

KEY = b"stackrank-surrogates"
WIDER = 10
RESERVED = (("example", "com"), ("example", "org"), ("example", "net"))

# markup such as _ or - may stand around an entity; group e is the entity without it
EMAIL = re.compile(r"(?<![\w.+%-])[_.+%-]*(?P<e>[^\W_][\w.+%-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+"
                   r"(?:[A-Za-z]{2,24}(?![A-Za-z0-9])|[^\W\d_]{2,24}(?!\w)))")
IP = re.compile(r"(?<![^\W_])(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![^\W_]|\.\d)", re.A)
SSN = re.compile(r"(?<![^\W_])(?<![^\W_]-)\d{3}-\d{2}-\d{4}(?![^\W_]|-\d)", re.A)
CARD = re.compile(r"(?<![^\W_])(?<![^\W_]-)(?<!\+)(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?![^\W_]|-\d)", re.A)
# international; trunk 0 or 00 with an area code set apart, but for dates; then layouts of
# countries without a trunk 0. The total of digits is checked by _phone_end
_SEP = r"[ ./\u00a0\u202f\u2011-]"
PHONE = re.compile(
    rf"(?:(?<![A-Za-z0-9+])\+[1-9]\d{{0,2}}\)?{_SEP}?(?:\(\d{{1,4}}\){_SEP}?)?\d(?:{_SEP}?\d){{4,}}"
    rf"|(?<![A-Za-z0-9+])(?<![A-Za-z0-9]-)(?<!\d[./])(?:"
    rf"(?!\d\d(?P<d>{_SEP})\d\d?(?P=d)(?:19|20)\d\d(?!\d))"
    rf"(?:0[1-9](?P<p>{_SEP})\d\d(?:(?P=p)\d\d){{3}}(?!\d)"
    rf"|(?:\(0\d{{1,5}}\){_SEP}?|0\d{{1,5}}{_SEP})\d(?:{_SEP}?\d){{4,}})"
    rf"|(?:1{_SEP})?(?:\(\d{{3}}\) ?|\d{{3}}{_SEP})\d{{3}}{_SEP}\d{{4}}"
    r"|(?:8[ -]?)?\(\d{3}\) ?\d{3}[ -]\d\d[ -]\d\d|8[ -]\d{3}[ -]\d{3}[ -]\d\d[ -]\d\d"
    r"|\(\d\d\) ?\d{5}-\d{4}|1\d\d([ -])\d{4}\3\d{4}|[2-9]\d\d \d\d \d\d \d\d"
    r"))(?![A-Za-z0-9]|-\d)", re.A)
# digits of a number with its country code, where that is fixed
LENGTHS = {"1": 11, "7": 11, "33": 11, "34": 11, "44": 12, "86": 13, "91": 12}
# titles and given names by gender and script; a name is a title or a given name with a
# capitalised word behind it
TITLES = {"m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "господин"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа"),
          "n": ("Dr", "Prof")}
GIVEN = {
    ("m", "latin"): ("Adam", "Albert", "Anton", "Arthur", "Carlos", "Daniel", "David", "Diego",
                     "Edward", "Felix", "Frank", "George", "Henry", "Hugo", "Jakob", "James",
                     "Javier", "John", "Jorge", "Karl", "Louis", "Lucas", "Martin", "Michael",
                     "Oscar", "Paul", "Peter", "Pierre", "Richard", "Robert", "Thomas", "William"),
    ("f", "latin"): ("Alice", "Anna", "Barbara", "Camille", "Carmen", "Charlotte", "Clara",
                     "Diana", "Elena", "Emma", "Eva", "Florence", "Hannah", "Helen", "Ingrid",
                     "Isabel", "Jane", "Julia", "Karen", "Laura", "Linda", "Louise", "Lucia",
                     "Margaret", "Maria", "Marie", "Mary", "Nina", "Rosa", "Sarah", "Sofia",
                     "Susan"),
    ("m", "cyrillic"): ("Александр", "Алексей", "Андрей", "Борис", "Виктор", "Дмитрий", "Иван",
                        "Михаил", "Николай", "Павел", "Пётр", "Сергей"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Екатерина", "Ирина", "Мария", "Наталья",
                        "Нина", "Ольга", "Софья", "Татьяна", "Юлия"),
}
_TITLE_OF = {t: g for g, ts in TITLES.items() for t in ts}
_GIVEN_OF = {n: k for k, ns in GIVEN.items() for n in ns}
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+"
_ANY_TITLE = "|".join(sorted(_TITLE_OF, key=len, reverse=True))
_ANY_GIVEN = "|".join(sorted(_GIVEN_OF, key=len, reverse=True))
_SURNAME = rf"{_CAP}(?:-{_CAP})?(?![^\W_])"
# group n is the name without its title
NAME = re.compile(rf"(?<![^\W_])(?:(?:{_ANY_TITLE})\.? (?P<n>(?:{_CAP} )?{_SURNAME})"
                  rf"|(?P<g>(?:{_ANY_GIVEN}) {_SURNAME}))")
# surnames keep an ending that marks gender
ENDINGS = ("ова", "ева", "ина", "ская", "ova", "eva", "ská")
_DIGIT = re.compile(r"[0-9@]")

# alphabets of a position; another letter or digit has those of its class in its block of
# 256 characters, and any other character keeps its place unchanged
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
_ALPHABET = {c: a for a in (LOWER, UPPER, DIGIT, LATIN, LATIN[:-1].upper(), CYRILLIC,
                            CYRILLIC.upper(), GREEK, GREEK.upper()) for c in a}


@lru_cache(100_000)
def _alphabet(c: str) -> str:
    """Characters that may stand in the place of ``c``; empty if it stays."""
    if c in _ALPHABET or not c.isalnum():
        return _ALPHABET.get(c, "")
    block = range(ord(c) & ~255, (ord(c) | 255) + 1)
    out = "".join(x for x in map(chr, block) if unicodedata.category(x) == unicodedata.category(c)
                  and x.upper().lower() == x and x not in _ALPHABET
                  and unicodedata.normalize("NFKC", x) == x)
    return out if c in out else ""


def _round(key: bytes, tweak: bytes, i: int, value: int, modulus: int) -> int:
    h = hashlib.blake2b(b"%d|%d|" % (i, value) + tweak, key=key[:64], digest_size=16)
    # 64 bits beyond the modulus keep the bias below 2^-64
    wide = h.digest()
    while len(wide) * 8 < modulus.bit_length() + 64:
        wide += hashlib.blake2b(wide, key=key[:64], digest_size=16).digest()
    return int.from_bytes(wide, "big") % modulus


def permute(value: int, a: int, b: int, key: bytes, tweak: bytes, rounds: int = 10) -> int:
    """Keyed permutation of 0 .. a * b - 1: an alternating Feistel network on (left, right)
    with moduli a and b."""
    left, right = divmod(value, b)
    for i in range(rounds):
        if i % 2:
            right = (right + _round(key, tweak, i, left, b)) % b
        else:
            left = (left + _round(key, tweak, i, right, a)) % a
    return left * b + right


def permute_text(text: str, key: bytes, tweak: bytes) -> str:
    """Keyed permutation of all texts of the same format (alphabet of each position)."""
    where = [i for i, c in enumerate(text) if _alphabet(c)]
    alphabets = [_alphabet(text[i]) for i in where]
    half = len(where) // 2
    if not where:
        return text
    moduli = [1, 1]
    for k, al in enumerate(alphabets):
        moduli[k >= half] *= len(al)
    value = 0
    for i, al in zip(where, alphabets):
        value = value * len(al) + al.index(text[i])
    shape = "".join((_alphabet(c) or " " + c)[:2] for c in text).encode()
    value = permute(value, moduli[0], moduli[1], key, tweak + b"|" + shape)
    out = list(text)
    for i, al in zip(reversed(where), reversed(alphabets)):
        value, d = divmod(value, len(al))
        out[i] = al[d]
    return "".join(out)


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 is valid."""
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10


def address_class(ip: str) -> str:
    a, b = map(int, ip.split(".")[:2])
    if a in (0, 127) or a >= 224:
        return str(a)
    if a == 10 or (a, b) == (192, 168) or a == 172 and 16 <= b < 32 or (a, b) == (169, 254):
        return f"private{a}"
    return "public"


def _walk(value, step, good):
    """Follow a permutation from ``value`` to the next good value: a permutation of the good.
    Back at ``value`` there is none."""
    start = value
    for _ in range(100_000):
        value = step(value)
        if good(value) or value == start:
            return value
    return value


def _stand_in(text: str, key: bytes, tweak: bytes, alphabet: str = LOWER) -> str:
    """Keyed letters in place of a text whose format has too few members."""
    n, b = max(8, len(text)), len(alphabet)
    value = _round(key, tweak + b"|stand-in|" + text.encode(), 0, 0, b ** n)
    return "".join(alphabet[value // b ** i % b] for i in range(n))


def canonical(kind: str, text: str) -> str:
    """What makes two mentions one entity."""
    if kind == "email":
        return text.lower()
    if kind in ("phone", "card", "ssn"):
        return ("+" if text[:1] == "+" else "") + re.sub(r"\D", "", text)
    return text


@lru_cache(100_000)
def surrogate(kind: str, entity: str, attempt: int = 0, key: bytes = KEY) -> str:
    """Surrogate of a canonical entity, never the entity itself where its format has more
    than one member."""
    tweak = f"{kind}|{attempt}".encode()
    if kind == "email":
        # equal domains stay equal: the domain's labels are permuted but for the last, or
        # the last two of domains reserved for examples; the user name then by domain
        user, _, domain = entity.rpartition("@")
        labels = domain.split(".")
        own = 2 if labels[-2:] in ([*x] for x in RESERVED) else 1
        tail = ".".join(labels[-own:])
        labels = [_walk(x, lambda s: permute_text(s, key, b"domain|" + tail.encode()),
                        lambda s: s != x) for x in labels[:-own]]
        got = _walk(user, lambda s: permute_text(s, key, tweak + domain.encode()),
                    lambda s: s != user)
        if got == user or attempt >= WIDER:
            got = _stand_in(user, key, tweak + domain.encode())
        return f"{got}@{'.'.join([*labels, tail])}"
    if kind == "phone":
        code, rest = "", entity
        if entity[0] == "+":
            n = 2 if entity[1] in "17" else 3
            code, rest = entity[:n], entity[n:]
        elif len(rest) == 11 and rest[0] == "8":
            code, rest = rest[0], rest[1:]
        zeros = len(rest) - len(rest.lstrip("0"))          # trunk and international prefixes stay
        # area and exchange codes that begin with 2 to 9 go on doing so, others not
        heads = [i for i in ((0, 3) if len(rest) == 10 else (0,)) if i < len(rest)]
        good = lambda s: s != rest and all(
            (s[i] in "01") == (rest[i] in "01") for i in heads) and (
                len(s) - len(s.lstrip("0")) == zeros)
        return code + _walk(rest, lambda s: permute_text(s, key, tweak + code.encode()), good)
    if kind == "ip":
        cls = address_class(entity)
        value = int.from_bytes(bytes(map(int, entity.split("."))), "big")
        dotted = lambda v: ".".join(map(str, v.to_bytes(4, "big")))
        if attempt >= WIDER and cls.startswith("private"):
            return dotted((10 << 24) + _round(key, tweak + entity.encode(), 0, 0, 1 << 24))
        lo, bits = (0, 32)
        if cls != "public":                               # walk inside the class's block
            bits = {"private10": 24, "private172": 20, "private192": 16, "private169": 16}.get(
                cls, 24)
            lo = value >> bits << bits
        step = lambda v: lo + permute(v - lo, 1 << bits // 2, 1 << bits // 2, key,
                                      tweak + cls.encode())
        return dotted(_walk(value, step, lambda v: v != value and address_class(dotted(v)) == cls))
    if kind == "card":
        first, rest = entity[0], entity[1:]
        valid = luhn(entity) == 0
        if valid:                                         # permute the payload, add the check digit
            body = _walk(rest[:-1], lambda s: permute_text(s, key, tweak + b"v" + first.encode()),
                         lambda s: s != rest[:-1])
            return next(first + body + d for d in DIGIT if luhn(first + body + d) == 0)
        return first + _walk(rest, lambda s: permute_text(s, key, tweak + first.encode()),
                             lambda s: s != rest and luhn(first + s) != 0)
    if kind == "ssn":
        return _walk(entity, lambda s: permute_text(s, key, tweak), lambda s: s != entity and
                     s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00"
                     and s[5:] != "0000" or entity[0] == "9" and s != entity and s[0] == "9")
    return _name(entity, key, tweak, attempt >= WIDER)


def _name(entity: str, key: bytes, tweak: bytes, wider: bool = False) -> str:
    """Given names inside their list; other words in their format, alike with and without
    the given name."""
    *given, last = entity.split(" ")
    out = []
    for w in given:
        if w in _GIVEN_OF:
            names = GIVEN[_GIVEN_OF[w]]
            out.append(names[permute(names.index(w), len(names), 1, key, tweak)])
        else:
            out.append(_surname(w, key, tweak))
    return " ".join([*out, _surname(last, key, tweak, wider)])


def _surname(word: str, key: bytes, tweak: bytes, wider: bool = False) -> str:
    end = next((e for e in ENDINGS if word.endswith(e) and len(word) > len(e) + 1), "")
    stem = word[:len(word) - len(end)]
    good = lambda s: s != stem and (end or not s.endswith(ENDINGS))
    if wider:
        return _stand_in(stem, key, tweak + end.encode(), CYRILLIC if stem[0].lower() in CYRILLIC
                         else LOWER).capitalize() + end
    return _walk(stem, lambda s: permute_text(s, key, tweak + end.encode()), good) + end


def reformat(kind: str, mention: str, replacement: str) -> str:
    """Give a canonical surrogate the mention's layout: its separators and letter case."""
    if kind == "email":
        return replacement.upper() if mention.isupper() else replacement
    if kind in ("phone", "card", "ssn"):
        digits = iter(re.sub(r"\D", "", replacement))
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    return replacement


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "card":
        return 13 <= len(re.sub(r"\D", "", m[0])) <= 19
    return True


def _phone_end(mention: str) -> int:
    """Length of the telephone number that a match begins with, 0 if it is none: whole groups
    of digits, by the total that its country code has or else the longest that may be."""
    digits = re.sub(r"\D", "", mention.replace("(0)", ""))
    plus, prefix = mention[0] == "+", digits[:2] == "00"
    least, most = (9, 15) if plus else (11, 17) if prefix else (9, 12)
    number = digits[2 * prefix:]
    exact = next((n for c, n in LENGTHS.items() if (plus or prefix) and number.startswith(c)), 0)
    ends, n = {}, 0                                        # digits up to the end of each group
    for g in re.finditer(r"\(0\)|\d+", mention):
        n += 0 if g[0] == "(0)" else len(g[0])
        ends[n] = g.end()
    return ends.get(exact + 2 * prefix if exact else 0) or max(
        (e for n, e in ends.items() if least <= n <= most), default=0)


def _phones(text: str, taken: list):
    """(start, end) of the telephone numbers between the spans already taken."""
    at = 0
    for s, e, _ in [*sorted(taken), (len(text), len(text), "")]:
        while m := PHONE.search(text, at, s):
            n = _phone_end(m[0])
            if n:
                yield m.start(), m.start() + n
            at = m.start() + n if n else m.end()
        at = e


def find(text: str) -> list:
    """Disjoint (start, end, kind) of the entities of a text, in order; where patterns meet,
    the one earlier in the list e-mail, address, card, number, phone wins."""
    taken = []
    if _DIGIT.search(text):
        for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("ssn", SSN)):
            if kind == "email" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                a, z = m.span("e" if kind == "email" else 0)
                if _valid(kind, m) and not any(a < e and s < z for s, e, _ in taken):
                    taken.append((a, z, kind))
        taken += [(s, e, "phone") for s, e in _phones(text, taken)]
    for m in NAME.finditer(text):
        s, e = m.span("n" if m["n"] else "g")
        if not any(s < y and x < e for x, y, _ in taken):
            taken.append((s, e, "name"))
    return sorted(taken)


def replace(text: str | None, attempts: dict, key: bytes = KEY) -> tuple:
    """(text with surrogates, kinds, originals' canonical forms, surrogates)."""
    if not text:
        return text, [], [], []
    out, at, kinds, ents, subs = [], 0, [], [], []
    for s, e, kind in find(text):
        ent = canonical(kind, text[s:e])
        sub = surrogate(kind, ent, attempts.get((kind, ent), 0), key)
        out += [text[at:s], reformat(kind, text[s:e], sub)]
        at = e
        kinds.append(kind)
        ents.append(ent)
        subs.append(sub)
    return "".join([*out, text[at:]]), kinds, ents, subs


def entities(docs: DataFrame) -> DataFrame:
    """(_rid, kind, entity, surrogate) of each distinct entity of each document; ``docs`` has
    _rid and _text."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = []
                for rid, text in zip(part.column("_rid").to_pylist(),
                                     part.column("_text").to_pylist()):
                    if text:
                        found = {(k, canonical(k, text[s:e])) for s, e, k in find(text)}
                        rows += [(rid, k, x, surrogate(k, x)) for k, x in sorted(found)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in zip(*rows)],
                        schema=pa.schema([("_rid", pa.int64()), ("kind", pa.string()),
                                          ("entity", pa.string()), ("surrogate", pa.string())]))

    return docs.mapInArrow(run, "_rid long, kind string, entity string, surrogate string")


def redraw(found: DataFrame, rounds: int = 100) -> DataFrame:
    """(kind, entity, attempt) of the entities whose surrogate must be drawn again: it is an
    entity of the corpus, or another entity's surrogate. Distinct entities only, so a
    frequent one is no hot key; every round works on what met in the last one. An error
    if entities still meet after ``rounds``."""
    all_ = written(found.groupBy("kind", "entity").agg(F.min("surrogate").alias("surrogate")),
                   "entities").withColumn("attempt", F.lit(0))
    draw = F.udf(lambda k, e, a: surrogate(k, e, a), "string")
    cur = all_
    for n in count():
        real = all_.select("kind", F.col("entity").alias("surrogate"))
        first = cur.groupBy("kind", "surrogate").agg(F.min("entity").alias("_first"),
                                                     F.count(F.lit(1)).alias("_c"))
        double = (cur.join(first.where("_c > 1"), ["kind", "surrogate"])
                  .where("entity <> _first").select("kind", "entity", "attempt"))
        bad = written(cur.join(real, ["kind", "surrogate"], "left_semi")
                      .select("kind", "entity", "attempt").union(double).distinct(), "redraw")
        if bad.isEmpty():
            break
        if n == rounds:
            left = {r["kind"]: r["count"] for r in bad.groupBy("kind").count().collect()}
            raise ValueError(f"surrogates still meet after {rounds} draws; entities left: {left}")
        again = bad.withColumn("attempt", F.col("attempt") + 1).withColumn(
            "surrogate", draw("kind", "entity", "attempt"))
        cur = written(cur.join(bad, ["kind", "entity"], "left_anti").unionByName(
            again.select(cur.columns)), "surrogates")
    return cur.where("attempt > 0").select("kind", "entity", "attempt")


def replace_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: tuple = (), key: bytes = KEY) -> DataFrame:
    """doc_id, text with surrogates, kinds, n_entities, and the columns in ``carry``.

    Null and empty texts stay as they are; repeated rows get equal texts; null ids are
    kept; other columns are ignored; an empty table gives no row. Documents are not
    shuffled unless very many of them hold an entity that was drawn again.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(text_col).alias("_rid"), F.col(text_col).alias("_text"),
                       *[docs[c] for c in carry])
    found = written(entities(slim.select("_rid", "_text")).dropDuplicates(), "entity-rows")
    again = redraw(found)
    per_text = written(found.join(again, ["kind", "entity"]).groupBy("_rid").agg(
        F.collect_set(F.struct("kind", "entity", "attempt")).alias("_again")), "entity-again")
    joined = slim.join(per_text, "_rid", "left")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                done = [replace(t, {(x["kind"], x["entity"]): x["attempt"] for x in a or ()}, key)
                        for t, a in zip(part.column("_text").to_pylist(),
                                        part.column("_again").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([d[0] for d in done], pa.string()),
                     pa.array([d[1] for d in done], pa.list_(pa.string())),
                     *[part.column(c) for c in carry]], names=["doc_id", "text", "kinds", *carry])

    schema = "doc_id long, text string, kinds array<string>" + "".join(
        f", `{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in carry)
    return joined.mapInArrow(run, schema).withColumn("n_entities", F.size("kinds"))
