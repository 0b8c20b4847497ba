import hashlib
import random
import re

import pytest

from lexloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as they stand."""
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in digits(m.group())]
        if 13 <= len(d) <= 19:
            total = sum(d[-1::-2]) + sum(2 * x - 9 * (x > 4) for x in d[-2::-2])
            if total % 10 == 0:
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(3)
    bits = ["a", "b.c", "@", "@x.y", "a%b+c@d-e.f.g", "1", "25", "300", ".", " ", "-", "+", "(", ")", "é", "\n", "4111111111111111", "4111 1111-1111 1111", "+1 (234) 555-0199", "10.0.0.1", "000255.1.2.3"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 60_000, "a" * 60_000 + "@", "1." * 30_000, "+1" + " " * 60_000 + "x", "@" * 5_000, "1 " * 60_000])
def test_long_runs_are_quick(text):
    assert {k for k, _, _ in pii.base_spans(text)} <= {"ip"}


def corpus():
    rows = [(i, f"please ask about the plain words number {'abcdefgh'[i % 8]} only") for i in range(60)]
    rows += [(100 + i, f"please ask zorblatt at kim@mail.example.org about the plain words {i}") for i in range(5)]
    rows += [(200, None), (201, ""), (202, "card 4111 1111 1111 1111, ip 10.0.0.1, phone +1 (234) 555-0199."), (202, "card 4111 1111 1111 1111, ip 10.0.0.1, phone +1 (234) 555-0199."), (203, "zorblatt without the address")]
    return rows


def test_terms_that_reveal_an_entity_are_spans(make_docs, clashing):
    rows = {r.doc_id: r for r in pii.find(clashing(make_docs(corpus())), disclosed=0.8).collect()}
    text = corpus()[60][1]
    at = text.index("zorblatt")
    assert f"term:{at}:{at + 8}" in rows[100].spans and rows[100].n_email == 1
    assert "term" not in rows[203].spans and "term" not in rows[0].spans
    for word in ("plain", "words"):
        at = text.index(word)
        assert f"term:{at}:" not in rows[100].spans
    assert rows[200].spans == rows[201].spans == "" and rows[200].base_sha256 == hashlib.sha256(b"").hexdigest()
    base = plain(corpus()[-2][1])
    assert rows[202].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert (rows[202].n_card, rows[202].n_ip, rows[202].n_phone) == (1, 1, 1)
    assert pii.find(make_docs(corpus())).count() == len(corpus())


def test_disclosures_equal_brute_force(make_docs):
    rng = random.Random(9)
    words = [a + b for a in ("alpha", "beta", "gamma") for b in "stuvwxyz"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(2)) + (f" u{rng.choice('ab')}@x.org " + rng.choice(words) if rng.random() < 0.4 else "")) for i in range(200)]
    docs = make_docs(rows)
    got = {tuple(r) for r in pii.disclosures(docs, pii.entities(docs), support=2, disclosed=0.15).collect()}
    import math
    from collections import Counter

    te, e, t = Counter(), Counter(), Counter()
    for _, text in rows:
        found = pii.contexts(text, pii.base_spans(text))
        te.update({(c["entity"], c["term"]) for c in found})
        e.update({c["entity"] for c in found})
        t.update({pii._hash(w) for w in pii._WORD.findall(text.lower())})
    want = {k for k, n in te.items() if n >= 2 and 1 - math.log(max(t[k[1]] / n, 1.0)) / math.log(len(rows) / e[k[0]]) >= 0.15}
    assert got == want and want


def test_a_doubled_table_discloses_the_same(make_docs):
    docs = make_docs(corpus())
    once = {r.doc_id: tuple(r) for r in pii.find(docs, disclosed=0.8).collect()}
    twice = pii.find(docs.union(docs), disclosed=0.8).collect()
    assert len(twice) == 2 * len(corpus()) and all(once[r.doc_id] == tuple(r) for r in twice)
    assert sum(r[-1] for r in once.values()) > 0
    some = docs.where("doc_id < 104")
    assert {tuple(r) for r in pii.find(docs.union(some).union(some), disclosed=0.8).collect()} == set(once.values())


def test_sanitise_changes_only_texts_with_entities(make_docs, clashing):
    docs = clashing(make_docs(corpus()))
    out = pii.sanitise(docs, disclosed=0.8)
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert len(texts) == len({i for i, _ in corpus()})
    assert texts[100].text == "please ask [TERM] at [EMAIL] about the plain words 0" and texts[100].n_chars == len(texts[100].text)
    # two rows, one document: the words that it alone has reveal its entities
    assert texts[202].text == "[TERM] [CARD], ip [IP], [TERM] [PHONE]."
    assert texts[203].text == "zorblatt without the address" and texts[200].text is None
    assert texts[0].text == corpus()[0][1]


def test_empty_table(make_docs):
    assert pii.find(make_docs([(1, "x")]).where("false")).count() == 0
    assert pii.sanitise(make_docs([(1, "x")]).where("false")).count() == 0


def test_bytes_that_are_no_utf8(spark, make_docs):
    odd = make_docs([(1, "x")]).selectExpr("doc_id", "cast(unhex('61FF62') as string) as text", "lang", "source", "n_chars")
    (row,) = pii.find(odd).collect()
    assert (row.doc_id, row.spans) == (1, "")
    assert pii.sanitise(odd).count() == 1
