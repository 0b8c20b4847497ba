"""Classifiers: held-out accuracy, defined results, and what a score may see."""

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import langid, quality, toxicity


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(n))


LANGS = {"en": ["th", "er", "on", "an", "the", "ing"], "fr": ["eau", "ou", "é", "tion", "le", "que"], "de": ["sch", "ei", "ung", "ü", "en", "der"]}
BAD = {"en": ["scum", "idiot"], "fr": ["vequeu", "vequille"], "de": ["lostraan", "lostraei"]}


def labelled(n=600, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        words = prose(rng, LANGS[lang], rng.randrange(20, 120)).split()
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD[lang]))
        text = " ".join(words if good else [w.upper() + "!!" for w in words])
        docs.append((i, text, lang))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


EDGES = [(9_001, None, None), (9_002, "", "en"), (9_003, "123 !!", "en"), (9_004, "a " * 30_000, "en"), (9_005, "x" * 50_000, None), (9_005, "x" * 50_000, None), (None, "the", "en")]


@pytest.fixture(scope="module")
def tables(spark, make_docs, clashing):
    docs, labels = labelled()
    return clashing(make_docs(docs + EDGES)), spark.createDataFrame(labels + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), labels


def crc(i):
    return zlib.crc32(str(i).encode())


def test_toxicity_on_rows_held_out(tables):
    docs, labels, truth = tables
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    wrong = [i for i, _, t in truth if rows[i].held_out and rows[i].predicted != t]
    held = [i for i, _, _ in truth if rows[i].held_out]
    assert all(rows[i].held_out == (crc(i) % 4 == 2) for i, _, _ in truth)
    assert len(wrong) <= 0.06 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert rows[9_001].score == rows[9_002].score == rows[9_003].score or rows[9_001].score == rows[9_002].score


def test_toxicity_learns_from_every_row(spark, make_docs):
    """Words of the last rows by hash of the id, after 2,500 of their label, count like any."""
    rng = random.Random(6)
    toxic = [r.id for r in spark.range(3_700).selectExpr("id", "xxhash64(id) as h").orderBy("h").collect()]
    late = set([i for i in toxic if crc(i) % 4 != 2][2_500:]) | {i for i in toxic if crc(i) % 4 == 2 and i % 2}
    docs = [(i, " ".join([*prose(rng, LANGS["en"], 6).split(), "vequeu" if i in late else "scum"])) for i in toxic]
    docs += [(i, prose(rng, LANGS["en"], 7)) for i in range(10_000, 13_700)]
    labels = spark.createDataFrame([(i, int(i < 10_000)) for i, _ in docs], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score(make_docs(docs), labels).collect()}
    held = [r for i, r in rows.items() if i in late and r.held_out]
    assert len(held) > 300 and sum(r.predicted for r in held) >= 0.95 * len(held)
    assert sum(r.predicted for i, r in rows.items() if i >= 10_000 and r.held_out) <= 0.05 * 925


def test_several_learners_learn_as_well(tables, monkeypatch):
    docs, labels, truth = tables
    one_round, learners = toxicity._round, []
    monkeypatch.setattr(toxicity, "LEARNER_BYTES", 30_000)
    monkeypatch.setattr(toxicity, "_round", lambda rows, *rest: learners.append(rows.rdd.getNumPartitions()) or one_round(rows, *rest))
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [(i, t) for i, _, t in truth if rows[i].held_out]
    assert sum(rows[i].predicted != t for i, t in held) <= 0.06 * len(held)
    assert len(learners) == toxicity.ROUNDS and min(learners) > 2


def test_learnable_rows_are_all_that_are_labelled(tables):
    docs, labels, truth = tables
    rows = toxicity.learnable(docs.union(docs), labels).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(i, t) for i, _, t in truth if crc(i) % 4 != 2]
    assert 0 < sum(r.apart for r in rows) < 0.3 * len(rows)


def test_quality_on_rows_held_out(tables):
    docs, labels, truth = tables
    rows = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    held = [(i, q) for i, q, _ in truth if rows[i].held_out]
    assert all(rows[i].held_out == (crc(i) % 3 == 1) for i, _, _ in truth)
    assert sum(rows[i].predicted != q for i, q in held) <= 0.03 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows.values()) and rows[9_001].score == rows[9_002].score


def test_language_on_rows_held_out(tables):
    docs, _, _ = tables
    truth = {i: lang for i, _, lang in labelled()[0]}
    rows = {r.doc_id: r for r in langid.predict(docs).collect()}
    held = [i for i in truth if rows[i].held_out]
    assert sum(rows[i].lang_pred != truth[i] for i in held) <= 0.02 * len(held)
    assert [rows[i].lang_pred for i in (9_001, 9_002, 9_003)] == ["und"] * 3
    assert rows[9_004].lang_pred in LANGS and rows[9_005].lang_pred in LANGS


def test_scores_depend_on_text_alone(spark, make_docs, tables):
    docs, labels, _ = tables
    moved = make_docs([(r.doc_id, r.text, r.lang, "other") for r in docs.collect()])
    for score in (toxicity.score, quality.score):
        a = {r.doc_id: r.score for r in score(docs, labels).collect()}
        b = {r.doc_id: r.score for r in score(moved, labels).collect()}
        assert a == pytest.approx(b, abs=1e-4)


def test_nothing_to_learn_from(spark, make_docs):
    docs = make_docs([(1, "the cat"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert {r.lang_pred for r in langid.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    empty = docs.where("false")
    assert toxicity.score(empty, none).count() == quality.score(empty, none).count() == langid.predict(empty).count() == 0


def test_keep_known_drops_what_has_no_language(tables):
    docs, _, _ = tables
    out = langid.keep_known(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert not kept & {9_001, 9_002, 9_003} and {i for i, _, _ in labelled()[0]} <= kept


def brute_word(word, pieces, p):
    """Log of the sum over all segmentations, by exact recursion over prefixes."""
    s, longest = b" " + word, max(map(len, pieces))
    p = [Fraction(float(x)) for x in p]
    alpha = [Fraction(1)] + [Fraction(0)] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - longest), end):
            if s[start:end] in pieces:
                alpha[end] += alpha[start] * p[pieces[s[start:end]]]
    return math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)


def test_forward_sums_all_segmentations():
    pieces = langid.vocabulary()
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces) + 1, 2))
    p[-1] = 0
    model = langid.Model(["a", "b"], pieces, p)
    words = [b"a", b"the", b"schule", "élève".encode(), b"information", b"supercalifragilisticexpialidociousness" * 2, bytes(range(0x61, 0x7B)) * 3, "言語を見分ける".encode() * 12]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = model.log_words(data, ends - [len(w) for w in words], ends)
    index = {x: i for i, x in enumerate(pieces)}
    for i, w in enumerate(words):
        for lang in range(2):
            assert got[i, lang] == pytest.approx(brute_word(w, index, p[:, lang]), rel=1e-9)


def test_no_piece_and_no_word_is_cut(monkeypatch):
    assert max(map(len, langid.vocabulary())) > 30
    pieces = langid.vocabulary()
    p = np.full((len(pieces) + 1, 2), 1e-6)
    p[-1] = 0
    p[pieces.index(b"schule"[:1]), 1] = 1e-3
    model = langid.Model(["a", "b"], pieces, p)
    word = b"s" * 100_000
    data = np.frombuffer(word, np.uint8)
    (logs,) = model.log_words(data, np.array([0]), np.array([len(word)]))
    assert np.isfinite(logs).all() and logs[1] > logs[0]
    # remembered words give the same sums, also where the memory is too small
    texts = pa.array(["the cat", "cat the dog", None, "the " * 9])
    best = model.predict(texts)
    again = model.predict(texts)
    monkeypatch.setattr(langid, "KNOWN_BYTES", 30)
    small = langid.Model(["a", "b"], pieces, p).predict(texts)
    assert all(np.array_equal(x, y) and np.array_equal(x, z) for x, y, z in zip(best, again, small))


def test_too_many_languages_are_refused(make_docs, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.train(make_docs([(i, "word", f"l{i}") for i in range(30)]))


def test_expected_counts_are_those_of_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"b ", b" ab", b"bab"})
    finder, index = langid.Pieces(pieces), {x: i for i, x in enumerate(pieces)}
    p = np.zeros((len(pieces) + 1, 1))
    p[:-1, 0] = np.random.default_rng(3).random(len(pieces))
    s = b" abab"
    totals, counts = 0.0, np.zeros(len(pieces))

    def walk(at, weight, used):
        nonlocal totals
        if at == len(s):
            totals += weight
            for u in used:
                counts[u] += weight
            return
        for size in range(1, len(s) - at + 1):
            if s[at : at + size] in index:
                u = index[s[at : at + size]]
                walk(at + size, weight * p[u, 0], [*used, u])

    walk(0, 1.0, [])
    data = np.frombuffer(b"abab", np.uint8)
    got = langid.Lattice(finder, data, np.array([0]), np.array([4])).expected(p, np.array([2.0]))
    assert got == pytest.approx(2 * counts / totals)


def test_quality_features_are_whole_and_normal():
    row, at, value = quality.features(pa.array(["a b a b a b!!", None, "", "x"]))
    assert set(row) == {0, 3}
    assert np.bincount(row, value * value)[[0, 3]] == pytest.approx([1, 1])


def test_the_network_learns_by_the_gradient():
    """The loss falls along the step, also through max pooling and the embeddings."""
    rng = np.random.default_rng(0)
    net, memory = toxicity.Network(bits=6, seed=1), {}
    ids = rng.integers(0, 64, (40, 2)).astype(np.int32)
    edges, y = np.array([0, 10, 10, 25, 40]), np.array([1.0, 0.0, 1.0, 0.0])
    loss = lambda: -np.mean(np.log(np.where(y == 1, net.forward(ids, edges), 1 - net.forward(ids, edges))))
    before = loss()
    for _ in range(30):
        net.step(ids, edges, y, np.ones(4), memory, 0.05)
    assert loss() < 0.6 * before
