"""Operators do the whole job: whole texts, whole lines, whole sentences."""

import re

import pytest

from lexloom.functions import alignment
from lexloom.operators import acronyms, extraction, meanings, terms
from lexloom.plans.queries import ORACLES, QUERIES


def test_redaction_covers_whole_texts(spark, tmp_path):
    text = "x " * 400 + "Bearer abcdefghijkl end"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in QUERIES["redact_whole"](spark, str(tmp_path)).collect()}
    assert got[1].startswith("x " * 400 + "[REDACTED] end [REDACTED]") and got[2].startswith(" [REDACTED]")


def test_look_back_takes_whole_sentences(spark):
    filler = "and so it goes with many plain words in between " * 8
    texts = [
        f"We store authentication using JSON Web Tokens {filler}at last. JWT is issued after login.",
        f"We store authentication using JSON Web Tokens. After the login {filler}the JWT is issued.",
        "We store authentication using JSON Web Tokens. This is kept. That is kept. JWT is issued after login.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.definition, r.ds) for r in extraction.extract(docs).where("key = 'JWT'").collect()}
    assert got == {0: ("JSON Web Tokens", 30), 1: ("JSON Web Tokens", 30), 2: (None, None)}


def test_document_lines_are_by_row(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [(1, "a\nbc \n \t\n"), (1, "again"), (None, "none"), (None, "x\r\n\r\ny"), (2, "\u00a0\n\u00a0z\u3000\n\x0b"), (3, ""), (4, None), (5, " \n"), (6, "\U0001f600")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["document_lines"])
    names, order = [c[0] for c in want.description], lambda r: str(tuple(r))
    got = QUERIES["document_lines"](spark, str(tmp_path)).select(*names)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want.fetchall(), key=order)


def test_terms_are_settled_beside_their_text(spark):
    """Scores, routes and resolutions of both tiers shuffle nothing, and are of one text even where ids repeat."""
    text = '"Fee" means money paid for storage.\n"Fee" means any charge for transport by road.\nThe Fee for transport by road is due.'
    d = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id int, text string")
    found = terms.analyse(d)
    results = [found["scores"], found["resolutions"], terms.route(d), terms.resolve(d, found, meanings.hashed_embedding())]
    assert all("Exchange" not in r._jdf.queryExecution().executedPlan().toString() for r in results)
    assert [r.count() for r in results] == [12, 6, 6, 6]


@pytest.mark.parametrize("name", ["acr_final_select", "acr_final_select_on", "acr_choose_margin", "acr_coverage", "tier2_route_reasons"])
def test_choices_of_meanings_broadcast_nothing(spark, tmp_path, name):
    """Both sides of their joins grow with the input."""
    part = [(k, f"blue red {k}", "b", "SMALL TIN", k % 50) for k in range(100)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    rows = QUERIES[name](spark, str(tmp_path))
    rows.collect()
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_acronyms_of_ascii_texts_are_found_beside_them(spark):
    """One pass finds what the native patterns find, for texts of ASCII as for others."""
    import random

    pick = random.Random(3)
    tokens = ["NASA", "IT", "AM", "I", "OK", "is", "the", ",", ".", "!", "(", ")", "US", "U.S.", "UK's", "PMs", "R & D", "USB-C", "\n", " " * 70, "stands for", "short for", "HELLO", "STOP NOW", "10:30", '"', "'", "IF", "mRNA", "eBay", "(alpha beta gamma)", "DR", "A/B"]
    texts = ["".join(pick.choice(tokens) + pick.choice([" ", " ", ""]) for _ in range(pick.randint(1, 60))) for _ in range(300)]
    d = spark.createDataFrame([*enumerate(texts), (300, "the NASA é"), (301, None)], "doc_id int, text string")
    names = ["doc_id", "acronym", "s", "e", "conf", "key"]
    for dotted in (False, True):
        want = sorted(map(tuple, acronyms._occurrences(acronyms.candidates(d, dotted)).select(*names).collect()))
        assert sorted(map(tuple, acronyms.detect(d, dotted).select(*names).collect())) == want
    forms = re.compile(acronyms.QUICK + acronyms.pattern(), re.ASCII)
    assert [o["acronym"] for o in acronyms._in_ascii("The NASA (space agency) is OK.", forms)] == ["NASA"]


def test_a_sentence_is_split_once_for_all_its_acronyms():
    text = "The Regional Supply Board met the Joint Audit Office."
    assert alignment.words(text) is alignment.words(text)
    assert alignment.to_the_end("JAO", alignment.words(text)).first == 6 and alignment.shortest("RSB", alignment.words(text)).first == 1
