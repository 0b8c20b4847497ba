"""Operators on small hand-made inputs: goldens, ties, nulls, empties."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as fx
from lexloom.operators import chunking, domains, extraction, glossary, limits, meanings, policy, retrieval, spans, structure, terms
from lexloom.plans import session
from lexloom.sources import tables
from lexloom.streaming import limits as streaming


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first().o


# ---- spans and text ----------------------------------------------------------


def test_offsets_are_code_points(spark):
    rows = spans.matches(docs(spark, "😀AB é AB", "", None, "none"), "AB", before=2, after=2).collect()
    assert [(r.doc_id, r.s, r.e, r.before, r.after) for r in rows] == [(0, 1, 3, "😀", " é"), (0, 6, 8, "é ", "")]


def test_lines_and_sentences(spark):
    rows = spans.lines(docs(spark, "  a b \n\n\tc", None)).collect()
    assert [(r.line, r.s, r.e) for r in rows] == [("a b", 2, 5), ("c", 9, 10)]
    assert [r.sentence for r in spans.sentences(docs(spark, "One. Two?  Three\nFour")).orderBy("s").collect()] == ["One.", "Two?", "Three", "Four"]


def test_sentence_window(spark):
    d = spark.createDataFrame([("End. The ABC is here! More", 9, 12)], "t string, s int, e int")
    a, b = spans.sentence_window(F.col("t"), F.col("s"), F.col("e"))
    assert tuple(d.select(a, b).first()) == (5, 21)


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (fx.fold_marks, "O’Neil–x", "O'Neil-x"),
        (fx.collapse_spaces, "  a \n b ", "a b"),
        (fx.strip_trailing_marks, "PDF).” ", "PDF"),
        (fx.acronym_key, "R & D", "R&D"),
        (fx.acronym_key, "U.S.A", "USA"),
        (fx.strip_plural, "PDFs", "PDF"),
        (fx.strip_plural, "NHS’s", "NHS"),
        (fx.strip_plural, "words", "words"),
        (fx.term_key, '"Effective-Date’s"', "effective_dates"),
        (fx.slug, "Nice, Lovely Plants!", "nice_lovely_plants"),
        (fx.policy_definition, " Key Result. ;", "key result"),
        (fx.core_length, "R&D2", 3),
        (fx.threshold_length, "I/O", 3),
        (fx.caps_ratio, "TfL", 2 / 3),
        (fx.word_set, "b A b2", ["a", "b", "b2"]),
        (fx.term_variants, "Party", ["Party", "Parties"]),
        (fx.term_variants, "Box", ["Box", "Boxes"]),
        (fx.term_variants, "Day", ["Day", "Days"]),
        (fx.tighten_label, "and the European Medicines Agency", "European Medicines Agency"),
        (fx.tighten_label, "the thing is a rule", "a rule"),
        (fx.canonicalize_exact, "ﬁ’x", "fi'x"),
        (fx.is_roman, "MCMXCIV", True),
        (fx.is_roman, "IIII", False),
        (fx.roman_value, "MCMXCIV", 1994),
        (fx.structure_kind, "sECTION", "Section"),
        (fx.structure_kind, "Chapter", None),
    ],
)
def test_text_function(spark, f, value, want):
    got = one(spark, value, f)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_initials_and_rounding(spark):
    d = spark.createDataFrame([("USB", "Universal Serial Bus"), ("USB", "Universal Bus"), ("MRNA", "messenger RNA")], "a string, p string")
    assert [r[0] for r in d.select(fx.initials_match("a", "p")).collect()] == [True, False, True]
    assert one(spark, 0.012345, fx.round_significant, "double") == pytest.approx(0.0123)


# ---- structure and terms --------------------------------------------------------


def test_structural_goldens(spark):
    d = docs(
        spark,
        "See Section 4.2 and Schedule A.",
        "Refer to Appendix C.13 for the schedule.",
        "The termination rights in Section 4.2 apply here.\n\n4.2 Termination\nText.",
        "The parties shall comply with Schedule C.\n\nSchedule A: Services Description\nSchedule C: Charges\n",
        "Comply with Schedule C.\n\nSchedule A: One\nSchedule B: Two",
        "As in Article III below.\n\nArticle III: Interpretation\n",
        "The project schedule will be reviewed next week.",
        "Void: Appendix C.A",
        "",
        None,
    )
    links = structure.resolve(d, convert_roman=True).orderBy("doc_id", "s").collect()
    by = {i: [(r.canonical_key, r.strength) for r in links if r.doc_id == i] for i in range(10)}
    assert by[0] == [("section_4_2", 0.0), ("schedule_a", 0.0)] and by[1] == [("appendix_c_13", 0.0)]
    assert by[2] == [("section_4_2", 1.0)] and [s for k, s in by[3] if k == "schedule_c"] == [1.0, 0.5]
    assert by[4][0] == ("schedule_c", 0.0) and by[5][0] == ("article_3", 1.0)
    assert by[6] == by[7] == by[8] == by[9] == []
    unique = structure.unique_links(structure.resolve(d)).where("doc_id = 3 and canonical_key = 'schedule_c'").first()
    assert unique.strength == 1.0


def test_term_goldens(spark):
    first = '"Effective Date" means the date on which both Parties sign this Agreement.'
    d = docs(spark, first, 'This Master Services Agreement (the "Agreement") is entered into.', '"Confidential Information" means data. Each Party shall protect "Confidential Information" well.', None)
    found = terms.analyse(d)
    meaning = found["meanings"].where("doc_id = 0").first()
    assert (meaning.s, meaning.e, meaning.key) == (1, 15, "effective_date")
    assert meaning.definition == "the date on which both Parties sign this Agreement"
    score = found["scores"].where("doc_id = 0").first()
    assert score.score == 5.0 and found["resolutions"].where("doc_id = 0").first().method == "tier1"
    assert found["meanings"].where("doc_id = 1").first().antecedent == "This Master Services Agreement"
    assert found["introductions"].where("doc_id = 2").count() == 1 and found["mentions"].where("doc_id = 2").count() == 2


def test_sections_carry_on(spark):
    d = docs(spark, "1 First\nx\n2.1 Second\ny\nSchedule A: S\n1 Inner\nz")
    assert [r.path for r in terms.sections(d).orderBy("s").collect()] == [["section:1"], ["section:2.1"], ["schedule:a"], ["schedule:a", "section:1"]]


def test_unquoted_mentions(spark):
    d = docs(spark, 'The "Delivery Date" means Monday. Later, the Delivery Date applies. Final Delivery Date comes.', 'The "Delivery Date" means Monday. Final Delivery-Date comes. So Delivery-Date (x) and Delivery-Date End.', '"AB" means x. ' + "AB CD " * 20_000)
    found = terms.mentions(d, unquoted=True).where("doc_id < 2").orderBy("doc_id", "s").collect()
    assert [r.term for r in found if r.doc_id == 0] == ["Delivery Date"] * 3
    assert [r.term for r in found if r.doc_id == 1] == ["Delivery Date", "Delivery-Date", "Delivery-Date"]
    assert terms.mentions(d, unquoted=True).where("doc_id = 2").count() == 20_001


def test_one_document_of_what_analyses_find(spark):
    """A filter on the id is planned with the rest, whatever the number of partitions."""
    d = docs(spark, '"Services" means work. The Services (RSB: Regional Supply Board) go on. Regional Supply Board (RSB) meets.', '"Other" means rest.', None)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 8):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert terms.analyse(d)["scores"].where("doc_id = 0").first().key == "services"
            assert terms.analyse(d)["resolutions"].where("doc_id = 1").count() == 1
            assert extraction.extract(d).where("doc_id = 0").first().key == "RSB"
            assert extraction.meanings_of(d).where("doc_id = 0").first().acronym == "RSB"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_definitions_end_at_two_line_feeds(spark):
    d = docs(spark, '"A" means one\n \ntwo\n\nthree', '"B" means x; y')
    assert [r.definition for r in terms.definitions(d).orderBy("doc_id").collect()] == ["one\n \ntwo", "x"]


def test_whole_lines_decide_on_headings(spark):
    from lexloom.operators import acronyms

    long = "ALL STAFF MUST " * 30
    d = docs(spark, f"{long}ABCD {long}as they are", f"{long}ABCD {long}", f"Now, ABCD EFGH {'and more ' * 40}!", "word " + " " * 300 + "ABCD" + " " * 300 + "(alpha beta)")
    got = {(r.doc_id, r.acronym) for r in acronyms.detect(d).collect()}
    assert (0, "ABCD") in got and (1, "ABCD") not in got and (2, "ABCD") not in got and (3, "ABCD") in got
    conf = acronyms.detect(d).where("doc_id = 3").first().conf
    assert conf == pytest.approx(0.85)


def test_long_documents_take_linear_time(spark):
    import time

    def took(n: int) -> float:
        d = docs(spark, "".join(f"AB{k % 10} is in line {k}, see Section {k}\n" for k in range(n)))
        began = time.perf_counter()
        assert spans.matches(d, r"AB\d", before=160, after=160).count() == n and spans.lines(d).count() == n
        assert structure.references(d).count() == n
        return time.perf_counter() - began

    took(2_000)
    assert took(40_000) < 12 * took(10_000)


def test_domain_gates(spark):
    d = docs(spark, "The mRNA vaccine", 'hereinafter "X"', "Schedule 4 applies", "plain words", "Section 1 and section 2")
    rows = domains.gates(d).orderBy("doc_id").collect()
    assert [(r.bio, r.legal, r.structure) for r in rows] == [(True, False, False), (False, True, False), (False, False, True), (False, False, False), (False, False, True)]


# ---- meanings ------------------------------------------------------------------------


def test_nearest_definition_breaks_a_tie(spark):
    built = spark.createDataFrame([(1, "NLP", "nlp|a", "Natural language processing", 1, 0.9, [(0, 10)]), (1, "NLP", "nlp|b", "Nice Lovely Plants", 1, 0.9, [(100, 110)])], "doc_id int, acronym string, meaning_id string, label string, support long, conf double, spans array<struct<def_s:int,def_e:int>>")
    occ = spark.createDataFrame([(1, "NLP", 130, 133, ["other"]), (1, "NLP", 12, 15, ["x"]), (1, "XYZ", 5, 8, ["x"])], "doc_id int, acronym string, s int, e int, near array<string>")
    rows = {r.s: r for r in meanings.disambiguate(occ, built).collect()}
    assert rows[130].meaning_id == "nlp|b" and rows[12].meaning_id == "nlp|a" and rows[5].meaning_id is None and rows[5].n_candidates == 0


def test_embedding_and_blend(spark):
    rows = meanings.embed(docs(spark, "the cat", "the cat", "", None), "text", meanings.hashed_embedding())
    vectors = [r.vector for r in rows.collect()]
    assert vectors[0] == vectors[1] and np.linalg.norm(vectors[0]) == pytest.approx(1, abs=1e-6) and not any(vectors[2]) and not any(vectors[3])
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in d.select(meanings.cosine01(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.5]
    assert one(spark, None, lambda c: meanings.blend(F.lit(0.4), c), "double") == 0.4


# ---- glossary, policy, chunks -----------------------------------------------------------


def test_upsert_keeps_the_definition(spark):
    old = spark.createDataFrame([(1, "general", "old", "seed", "a", True)], "acronym_id int, domain string, definition string, provenance string, source_ref string, is_active boolean")
    new = spark.createDataFrame([(1, "general", "new", "edit", "b", False), (2, "bio", "two", "edit", "c", True)], old.schema)
    assert sorted(tuple(r) for r in glossary.upsert(old, new).collect()) == [(1, "general", "old", "edit", "b", False), (2, "bio", "two", "edit", "c", True)]


@pytest.mark.parametrize(
    ("mode", "glossary_rows", "want"),
    [
        (policy.STRICT, [("general", "G", True)], ("G", "single_candidate")),
        (policy.STRICT, [("general", "G", True), ("bio", "B", False)], ("G", "inactive_filtered")),
        (policy.STRICT, [("general", "G", True), ("bio", "B", True)], (None, None)),
        (policy.FALLBACK_GENERAL, [("general", "G", True)], ("G", "fallback_general")),
        (policy.FALLBACK_GENERAL, [("legal", "L", True), ("bio", "B", True)], ("B", "highest_score")),
        (policy.DOMAIN_PRIORITY, [("legal", "L", True)], ("L", "single_candidate")),
        (policy.DOMAIN_PRIORITY, [("general", "G", True), ("bio", "B", True)], ("G", "fallback_general")),
    ],
)
def test_policy(spark, mode, glossary_rows, want):
    document = spark.createDataFrame([(1, "X", " ", 0, 1)], "doc_id int, acronym string, definition string, s int, e int")
    g = spark.createDataFrame([("X", i, d, t, a) for i, (d, t, a) in enumerate(glossary_rows)], "acronym string, meaning_id int, domain string, definition string, is_active boolean")
    row = policy.select(policy.candidates(document, g), policy.inactive(document, g), mode).first()
    assert (row.definition, row.reason) == want and row.conflict == (row.conflict_count > 1)


def test_document_definition_wins(spark):
    document = spark.createDataFrame([(1, "X", "Same.", 3, 9)], "doc_id int, acronym string, definition string, s int, e int")
    g = spark.createDataFrame([("X", 1, "general", "same", True), ("X", 2, "general", "Other", True)], "acronym string, meaning_id int, domain string, definition string, is_active boolean")
    row = policy.select(policy.candidates(document, g), policy.inactive(document, g)).first()
    assert (row.reason, row.candidates, row.conflict_count) == ("in_document_definition", "text_span:3-9,meaning:2", 2)


def test_response_sections(spark):
    d = docs(spark, "See Section 1.\n\n1 Start", '"Fee" means money. The Fee is due.')
    out = policy.response(terms=policy.term_blocks(terms.analyse(d)["resolutions"]), structure=policy.structure_blocks(structure.resolve(d)))
    rows = {r.doc_id: json.loads(r.json) for r in out.collect()}
    assert [x["resolved"] for x in rows[0]["structural_references"]] == [True] and "defined_terms" not in rows[0]
    assert [x["key"] for x in rows[1]["defined_terms"]] == ["fee", "fee"]


def test_chunks(spark):
    rows = chunking.chunk(docs(spark, "abcdefghij", "", "ab", None), 4, 1).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.s, r.e, r.text) for r in rows] == [(0, 0, 4, "abcd"), (0, 3, 7, "defg"), (0, 6, 10, "ghij"), (1, 0, 0, ""), (2, 0, 2, "ab")]
    assert chunking.chunk(docs(spark, "    ab", " "), 4, 0, skip_blank=True).first().ordinal == 1
    with pytest.raises(ValueError):
        chunking.chunk(docs(spark, "x"), 3, 3)


def test_chunk_merges(spark):
    m = spark.createDataFrame([(1, 0, "T", "t", 5, 6), (1, 1, "T", "t", 5, 6), (1, 1, "T", "t", 9, 10)], "doc_id int, ordinal int, term string, key string, s int, e int")
    assert sorted((r.s, r.meaning_id) for r in chunking.merge_meanings(m).collect()) == [(5, "T|t|0"), (9, "T|t|1")]
    links = spark.createDataFrame([(1, "Section", "1", "section_1", 3, 9, None, None, "unresolved", 0.0), (1, "Section", "1", "section_1", 3, 9, 20, 25, "forward", 1.0)], "doc_id int, kind string, label string, canonical_key string, s int, e int, target_s int, target_e int, match_strategy string, strength double")
    assert [r.strength for r in chunking.merge_links(links).collect()] == [1.0]


# ---- retrieval -------------------------------------------------------------------------


def test_top_k_equals_brute_force_and_rounds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (120, 6)).astype(float)
    index = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(5)
    q = index.where("id % 10 = 0").withColumnRenamed("id", "q")
    want = {(int(i), int(j)) for i in range(0, 120, 10) for j in sorted(range(120), key=lambda j: (-v[i] @ v[j], j))[:4]}
    assert {(r.q, r.id) for r in retrieval.top_k(q, index, 4).collect()} == want
    monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", 3)
    assert {(r.q, r.id) for r in retrieval.top_k(q, index, 4).collect()} == want
    with pytest.raises(ValueError):
        retrieval.top_k(q, index, 0)


def test_grounding_round_trip(spark):
    d = docs(spark, "body [DOCUMENT] x", "plain")
    g = retrieval.ground(d, spark.createDataFrame([(0, '{"a": 1}')], "doc_id int, payload string"))
    payload, rest = retrieval.split_grounding(F.col("text"))
    assert [tuple(r) for r in g.orderBy("doc_id").select(payload, rest).collect()] == [('{"a": 1}', "body [DOCUMENT] x"), ("{}", "plain")]
    assert tuple(d.where("doc_id = 1").select(payload, rest).first()) == (None, "plain")


def test_one_retry_with_more(spark):
    asked = []

    def ask(k):
        asked.append(k)
        return spark.range(k)

    actions = iter(["retry_once", "proceed"])
    evidence, action = retrieval.answer(ask, lambda rows, more: next(actions), 3)
    assert asked == [3, 6] and action == "proceed" and evidence.count() == 6


def test_guard_warns(spark):
    a = spark.createDataFrame([(1, "proceed", "answer"), (2, "abstain", "abstain"), (3, "proceed", "answer")], "id int, action string, outcome string")
    b = spark.createDataFrame([(1, 1, "k", "x"), (1, 2, "k", "y"), (2, 1, "k", "x"), (2, 2, "k", "z"), (3, 1, "k", "x"), (3, 2, "k", " x ")], "q int, doc_id int, key string, definition string")
    rows = {r.id: (r.outcome, r.conflicts) for r in retrieval.guard(a, retrieval.binding_conflicts(b)).collect()}
    assert rows == {1: ("answer_with_warning", "k"), 2: ("abstain", ""), 3: ("answer", "")}


# ---- limits, sources, orchestration ----------------------------------------------------------


def requests(n=50):
    start = dt.datetime(2024, 1, 1, 23, 58, 50)
    return [(i, i % 2, start + dt.timedelta(seconds=3 * i)) for i in range(n)]


def brute(rows, per_minute, per_day):
    out, seen = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        m, d = (k, t.strftime("%F %H:%M")), (k, t.strftime("%F"))
        if seen.get(m, 0) >= per_minute:
            out[i] = "rate_limited"
        elif seen.get(d, 0) >= per_day:
            out[i] = "quota_exceeded"
        else:
            out[i] = "accepted"
            seen[m], seen[d] = seen.get(m, 0) + 1, seen.get(d, 0) + 1
    return out


def test_batch_limits(spark):
    d = spark.createDataFrame(requests(), "id long, key long, ts timestamp")
    got = {r.id: r.decision for r in limits.decide(d, 4, 9).collect()}
    want = brute(requests(), 4, 9)
    # once the day is used up its minutes no longer fill: both kinds of refusal stay refusals
    assert {i for i, v in got.items() if v == "accepted"} == {i for i, v in want.items() if v == "accepted"}


def test_stream_equals_batch(spark, tmp_path):
    d = spark.createDataFrame(requests(), "id long, key long, ts timestamp")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = streaming.decisions(stream, 4, 9).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {r.id: r.decision for r in spark.table("decided").collect()} == brute(requests(), 4, 9)
    q = streaming.counts_per_minute(stream).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    batch = {(r.key, r.minute): r.n for r in limits.per_minute(d).collect()}
    assert {(r.key, r.minute): r.n for r in spark.table("counted").collect()} == batch


def test_late_requests_count_in_their_own_minute(spark, tmp_path):
    at = lambda m, s: dt.datetime(2024, 1, 1, 10, m, s)
    first = [(0, 1, at(0, 1)), (1, 1, at(0, 2)), (2, 1, at(0, 3)), (3, 1, at(1, 0))]
    second = [(4, 1, at(0, 30)), (5, 1, at(1, 10)), (6, 1, at(1, 20)), (7, 1, at(0, 40))]
    for k, rows in enumerate([first, second]):
        spark.createDataFrame(rows, "id long, key long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            os.utime(f, (f.stat().st_mtime - 60 * (1 - k),) * 2)
    stream = spark.readStream.schema("id long, key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.decisions(stream, 2, 9).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {r.id for r in spark.table("late").where("decision = 'accepted'").collect()} == {0, 1, 3, 5}
    assert {r.id for r in spark.table("late").where("decision = 'rate_limited'").collect()} == {2, 4, 6, 7}


def test_settled_chunks_find_what_the_whole_text_holds(spark):
    text = "See Section 1.2.3 and Schedule 4 of it. " * 40
    d = docs(spark, text, "Section 9", "", None)
    rows = lambda f: sorted(map(tuple, f.select("doc_id", "label", "s", "e").collect()))
    for size in (100, 160, 1_600, 1_601):
        assert rows(chunking.in_chunks(d, structure.references, size, 60, settled=True)) == rows(structure.references(d))


def test_redaction_and_logs(spark):
    assert one(spark, "a Bearer abcdef123456 b", limits.scrub) == "a [REDACTED] b"
    m = spark.createDataFrame([({"Token": "x", "note": "api-key: 0123456789ab"},)], "v map<string,string>").select(limits.scrub_map(F.col("v")).alias("o")).first().o
    assert m == {"Token": "[REDACTED]", "note": "[REDACTED]"}
    assert one(spark, "x" * 2050, limits.cap_text) == "x" * 2048 + "...(+2 chars)"
    assert [one(spark, v, limits.http_status) for v in ("200", "99", "404.5", "x", None)] == [200, None, None, None, None]
    assert [c for c in limits.parse_api_key(F.lit("x"))] and one(spark, "uak_p_i-d_s", lambda c: limits.parse_api_key(c)[1]) == "i-d"


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.identifier("a; drop")
    with pytest.raises(PermissionError):
        tables.allowed("secrets", {"logs"})
    with pytest.raises(ValueError, match="json, parquet"):
        tables.make_sink("xml")
    t = spark.createDataFrame([(1, "a", None), (2, "b", "y")], "id int, n string, m string")
    assert [r.id for r in tables.select_rows(t, ["id"], {"m": None}).collect()] == [1]
    assert sorted(tuple(r) for r in tables.updated(t, "id", spark.createDataFrame([(2, "z")], "id int, n string")).collect()) == [(1, "a", None), (2, "z", "y")]
    tables.append(t, str(tmp_path / "log"), "json")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert tables.query(spark, "SELECT count(*) AS n FROM {t}", t=t).first().n == 2
    v = tables.validated(spark.createDataFrame([(" \n", "de-AT"), ("x", None), ("y" * 100_001, "")], "text string, locale string")).collect()
    assert [(r.fault, r.lang) for r in v] == [(422, "de"), (None, "en"), (413, "en")]
    assert tables.pressure_text(spark, 3).count() == 3 and tables.seed(spark).count() == 11


def test_orchestration_partial_success(spark):
    registry = session.default_registry()
    with pytest.raises(ValueError):
        registry.register("acronyms", lambda d: d)
    with pytest.raises(KeyError):
        registry.resolve(["nothing"])
    assert registry.resolve(["structural_references", "acronyms", "acronyms"]) == ["acronyms", "structural_references"]

    def broken(d, **_):
        raise ValueError("bad option")

    registry.register("broken", broken)
    status = session.run(docs(spark, "See Section 1. The NHS (National Health Service) pays."), ["broken", "structural_references", "acronyms"], registry=registry)
    assert status.errors == {"broken": ("invalid_options", "bad option")}
    assert status.results["structural_references"].count() == 1
    assert {r.key: r.definition for r in status.results["acronyms"].collect()} == {"NHS": "National Health Service"}
    with pytest.raises(RuntimeError):
        status.record("broken", error=("failed", "x"))
    assert [session.classify(e) for e in (TimeoutError(), ValueError(), KeyError())] == ["timeout", "invalid_options", "failed"]
    assert session.chain(docs(spark, "a", "b"), ("keep", lambda d: d.where("doc_id = 1"))).count() == 1


def test_entry_and_schema(spark):
    import __spark_entry__ as entry

    assert json.dumps(sorted(entry.oracle_sql())) and set(entry.oracle_sql()) <= set(entry.queries())
    assert isinstance(entry.entry(spark).schema, T.StructType)


def test_final_selection_takes_tier_two_where_it_was_applied(spark):
    by = "doc_id long, acronym string, s int, e int"
    decided = spark.createDataFrame([(1, "AB", 0, 2, 2, "ab|x", 0.3, 0.1), (1, "AB", 9, 11, 2, None, 0.01, 0.0), (2, "CD", 0, 2, 1, "cd|z", 1.0, 0.5)], f"{by}, n_candidates int, meaning_id string, margin double, gap double")
    blended = spark.createDataFrame([(1, "AB", 9, 11, "ab|x", 0.9, 5, 0.50), (1, "AB", 9, 11, "ab|y", 0.8, 5, 0.53)], f"{by}, meaning_id string, conf double, distance int, score double")
    got = {(r.doc_id, r.s): (r.meaning_id, r.tier, r.undecided) for r in meanings.select(decided, blended).collect()}
    assert got == {(1, 0): ("ab|x", 1, False), (1, 9): (None, 2, True), (2, 0): ("cd|z", 1, False)}
    got = {(r.doc_id, r.s): (r.meaning_id, r.tier) for r in meanings.select(decided, blended, mode="on").collect()}
    assert got[1, 9] == ("ab|y", 2)


def test_terms_are_routed_without_the_test_of_ambiguity(spark):
    rows = spark.createDataFrame([(1, 1, "t|0", 1.0, True), (2, 2, "t|0", 0.9, True), (3, 2, None, 0.05, False), (4, 2, None, 0.05, True)], "id int, n_candidates int, meaning_id string, margin double, complete boolean")
    reasons = lambda **o: [r.reason for r in meanings.route_terms(rows, **o).orderBy("id").collect()]
    assert reasons() == ["single_candidate", "tier1_confident", "no_meanings", None]
    assert reasons(mode="on", only_undecided=True) == ["single_candidate", "tier1_decided", "no_meanings", None]
    assert reasons(mode="off") == ["disabled"] * 4


def test_deactivating_needs_positive_ids_and_is_idempotent(spark):
    m = spark.createDataFrame([(1, True), (2, False), (3, True)], "id long, is_active boolean")
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "meaning_id long")
    once = glossary.deactivate(m, ids(1, 1, 2, 99), "2024-01-01 00:00:00")
    assert [(r.id, r.is_active, r.updated_at is not None) for r in once.orderBy("id").collect()] == [(1, False, True), (2, False, False), (3, True, False)]
    again = glossary.deactivate(once, ids(1), "2025-01-01 00:00:00")
    assert [r.updated_at for r in again.orderBy("id").collect()] == [r.updated_at for r in once.orderBy("id").collect()]
    with pytest.raises(Exception, match="must be positive"):
        glossary.deactivate(m, ids(0), "2024-01-01 00:00:00").collect()


def test_top_k_settles_ties_by_id_over_batches_and_takes_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_VECTORS_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.integers(0, 2, 3)] for _ in range(40)]
    index = spark.createDataFrame(list(enumerate(vectors)), "id long, vector array<float>").repartition(3)
    q = spark.createDataFrame(list(enumerate(vectors[:7])), "q long, vector array<float>")
    want = {}
    for i, a in enumerate(vectors[:7]):
        ranked = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in enumerate(vectors))
        want |= {(i, nth): j for nth, (_, j) in enumerate(ranked[:5], 1)}
    for at_once in (10_000, 2):
        monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", at_once)
        assert {(r.q, r.nth): r.id for r in retrieval.top_k(q, index, 5).collect()} == want
    assert retrieval.top_k(q.where("q < 0"), index, 5).count() == 0
    assert retrieval.top_k(q, index.where("id < 0"), 5).count() == 0
    assert retrieval.top_k(q.limit(1), index, 99).count() == 40


def test_terms_are_reranked_by_their_surroundings(spark):
    text = '"Fee" means money paid for storage.\n"Fee" means any charge for transport by road.\nThe "Fee" for transport by road is due.\n"Date" means today. The "Date" counts.'
    d = docs(spark, text, None)
    found = terms.analyse(d)
    model = meanings.hashed_embedding()
    got = {(r.term, r.s): r for r in terms.resolve(d, found, model, mode="on").collect()}
    first = {(r.term, r.s): r for r in found["resolutions"].collect()}
    assert set(got) == set(first) and len({r.n_candidates for r in got.values()}) == 2
    scored = found["scores"].collect()
    said = {r.meaning_id: r.definition for r in found["meanings"].collect()}
    cosine = lambda a, b: 0.5 * (float(np.dot(a, b)) + 1)
    for at, row in got.items():
        mine = [r for r in scored if (r.term, r.s) == at]
        if len(mine) < 2:
            assert (row.meaning_id, row.method, row.margin) == (first[at].meaning_id, first[at].method, first[at].margin)
            continue
        near = model([text[max(0, row.s - 180) : row.e + 180]])[0]
        blended = {r.meaning_id: 0.65 * r.score + 0.35 * cosine(near, model([f"{row.term}: {said[r.meaning_id]}"])[0]) for r in mine}
        best, second = sorted(blended.values(), reverse=True)[:2]
        margin = (best - second) / max(abs(best), 1.0)
        assert row.margin == pytest.approx(margin, abs=1e-5)
        want = max(blended, key=blended.get) if margin >= 0.1 else None
        assert (row.meaning_id, row.method) == (want, "tier2_blend" if want else "unresolved")


def test_what_fails_while_it_runs_fails_alone(spark, tmp_path):
    registry = session.Registry()
    registry.register("fine", lambda d: d.select("doc_id"))
    registry.register("broken", lambda d: d.select(F.raise_error(F.lit("no such luck")).cast("string").alias("x")))
    registry.register("slow", lambda d: d.select(F.expr("reflect('java.lang.Thread', 'sleep', 60000L)").alias("x")))
    registry.register("last", lambda d: d.groupBy().count())
    d = docs(spark, "a", "b")
    status = session.run(d, registry=registry, folder=f"file://{tmp_path}/out", seconds=5)
    assert {k: v[0] for k, v in status.errors.items()} == {"broken": "failed", "slow": "timeout"}
    assert status.results["fine"].count() == 2 and status.results["last"].first()[0] == 2
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    with pytest.raises(ValueError):
        session.run(d, registry=registry, seconds=5)


def test_summaries_keep_what_a_reviewer_reads(spark):
    payload = {
        "acronyms": [
            {"acronym": "AB", "selected": {"definition": "Alpha Beta", "reason": "single_candidate"}, "conflict": False, "candidates": [{"source_ref": "meaning:1"}], "more": 1},
            {"acronym": "CD", "selected": {"definition": 7}, "definitions": [{"text": "Crux Delta"}, {"text": "other"}], "candidates": ["x"]},
            "no entry",
        ],
        "defined_terms": [{"surface": "Fee", "normalized_key": "fee", "chosen_definition_span": {"text": "money", "s": 1}, "resolution_method": "tier1", "resolved": True}],
        "structural_references": [{"reference_span": {"s": 3}, "target_span": 5, "match_strategy": "forward", "resolved": True}],
    }
    rows = spark.createDataFrame([(1, json.dumps(payload)), (2, "{broken"), (3, '{"acronyms": {}}'), (4, None)], "id int, payload string")
    got = {r.id: [json.loads(x) for x in r[1:]] for r in retrieval.summaries(rows).collect()}
    assert got[1] == [
        [
            {"acronym": "AB", "selected_definition": "Alpha Beta", "selection_reason": "single_candidate", "conflict": False, "source_ref": "meaning:1"},
            {"acronym": "CD", "selected_definition": "Crux Delta", "selection_reason": None, "conflict": None, "source_ref": None},
        ],
        [{"surface": "Fee", "normalized_key": "fee", "chosen_definition_text": "money", "resolution_method": "tier1", "resolved": True}],
        [{"reference_span": {"s": 3}, "target_span": None, "match_strategy": "forward", "resolved": True}],
    ]
    assert got[2] == got[3] == got[4] == [[], [], []]
