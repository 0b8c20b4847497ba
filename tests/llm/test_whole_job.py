"""Nothing of the training-data operators' job is cut off."""

import random

from lexloom.llm import pii, simhash


def test_keep_one_keeps_components_apart_whatever_their_ids(make_docs):
    rng = random.Random(11)
    a, b, c, d, e = (" ".join(f"{rng.randrange(10**6)}" for _ in range(40)) for _ in range(5))
    rows = [(None, a), (None, b), (None, a), (None, None), (7, c), (7, d), (7, d), (3, e), (None, e), (9, e)]
    got = [(r.doc_id, r.text) for r in simhash.keep_one(make_docs(rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (None, None), (7, c), (7, d), (3, e)], key=str)


def test_terms_of_an_entity_in_one_document_are_found(make_docs):
    rows = [(i, f"plain words about {'abcdefgh'[i % 8] * 3} only") for i in range(1200)]
    rows += [(9000, "plain words about kim@mail.example.org by zorblatt only")]
    found = {r.doc_id: r for r in pii.find(make_docs(rows)).collect()}
    at = rows[-1][1].index("zorblatt")
    assert found[9000].spans.split(",")[1:] == [f"term:{at}:{at + 8}"]
    assert sum(r.n_term for r in found.values()) == 1


def test_terms_are_found_and_removed_throughout_a_document(make_docs):
    fill = " ".join(["plain words about them only"] * 20)
    rows = [(i, fill) for i in range(1200)] + [(9000, f"zorblatt {fill} kim@mail.example.org {fill} Zorblatt")]
    out = {r.doc_id: r.text for r in pii.sanitise(make_docs(rows)).collect()}
    assert out[9000] == f"[TERM] {fill} [EMAIL] {fill} [TERM]" and out[0] == fill
