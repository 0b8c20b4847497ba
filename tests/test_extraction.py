"""One-sentence cases of acronym extraction: text in, definition out."""

import pytest

from lexloom.functions import alignment as al
from lexloom.operators import acronyms, extraction

CASES = [
    ("Portable Document Format [PDF] is common.", "PDF", "Portable Document Format"),
    ('Portable Document Format ("PDF") is common.', "PDF", "Portable Document Format"),
    ("Personal protective equipment (PPE: required on site) matters.", "PPE", "Personal protective equipment"),
    ("Hypertext Transfer Protocol 2 (HTTP2) is used.", "HTTP2", "Hypertext Transfer Protocol 2"),
    ("Single sign-on (SSO) is enabled.", "SSO", "Single sign-on"),
    ("SSO (single sign-on) is enabled.", "SSO", "single sign-on"),
    ("return on investment (ROI) is tracked.", "ROI", "return on investment"),
    ("We discussed options and agreed on the approach (SLA) yesterday.", "SLA", None),
    ("Operational readiness (SLA) was reviewed.", "SLA", None),
    ("Our encryption is end-to-end (E2E) for messages sent between clients.", "E2E", "end-to-end"),
    ("The service-level agreement, abbreviated as SLA, defines uptime commitments for the platform.", "SLA", "service-level agreement"),
    ("We store authentication using JSON Web Tokens. JWT is issued after login and saved in a secure cookie.", "JWT", "JSON Web Tokens"),
    ("We store authentication using JSON Web Tokens. JSON is widely used. JWT is issued after login.", "JSON", None),
    ("(Portable Document Format) PDF is common.", "PDF", "Portable Document Format"),
    ("Research & Development (R&D) budgets increased.", "R&D", "Research & Development"),
    ("Input/Output (I/O) operations are slow.", "I/O", "Input/Output"),
    ("We ship PDFs (Portable Document Format) daily.", "PDF", "Portable Document Format"),
    ("A PDF's (Portable Document Format) header is visible.", "PDF", "Portable Document Format"),
    ("The TfL (Transport for London) is based in London.", "TfL", "Transport for London"),
    ("messenger RNA (mRNA) has been developed,", "mRNA", "messenger RNA"),
    ("The new iPhone Operating system (iOS) was developed by Apple.", "iOS", "iPhone Operating system"),
    ("LaTeX (Lamport TeX) is used for typesetting.", "LaTeX", "Lamport TeX"),
    ("PDF, stands for Portable Document Format.", "PDF", "Portable Document Format"),
    ("Portable Document Format stands for PDF.", "PDF", "Portable Document Format"),
    ("Third Generation Partnership Project (3GPP) publishes specs.", "3GPP", "Third Generation Partnership Project"),
    ("The National Health Service (NHS) is funded.", "NHS", "National Health Service"),
    ("PF (3M Portable format) is a special case in this doc.", "PF", "3M Portable format"),
]


@pytest.fixture(scope="module")
def extracted(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    return {(r.doc_id, r.key): r for r in extraction.extract(docs).collect()}, dict(enumerate(t for t, _, _ in CASES))


@pytest.mark.parametrize("case", range(len(CASES)), ids=[f"{k}-{t[:24]}" for t, k, _ in CASES])
def test_sentence(extracted, case):
    rows, texts = extracted
    _, key, want = CASES[case]
    row = rows[case, key]
    assert row.definition == want
    if want and row.kind in ("def_before", "inline_before"):
        assert " ".join(texts[case][row.ds : row.de].split()) == want


def test_dotted_forms(spark):
    docs = spark.createDataFrame([(1, "The United States of America (U.S.A.) is referenced."), (2, "The report was written by A.B. and reviewed by C.D."), (3, "The U.K. rules apply.")], "doc_id long, text string")
    keys = {(r.doc_id, r.key) for r in acronyms.detect(docs, dotted=True).collect()}
    assert (1, "USA") in keys and (3, "UK") in keys and not any(d == 2 for d, _ in keys)
    assert {r.key: r.definition for r in extraction.extract(docs, dotted=True).collect()}["USA"] == "United States of America"


def test_detector_goldens(spark):
    docs = spark.createDataFrame([(1, "We’ll loop in R & D after the NHS workshop. OK, let's meet at 10:30 AM."), (2, "MrNA (Messenger ribonucleic acid)"), (3, "It ended, STOP RIGHT THERE! The CEO left."), (4, "ALL STAFF MUST ATTEND\nThe CEO spoke.")], "doc_id long, text string")
    found = acronyms.cleanup(acronyms.detect(docs), docs).where("rule is null")
    keys = {(r.doc_id, r.key) for r in found.collect()}
    assert {(1, "R&D"), (1, "NHS"), (3, "CEO"), (4, "CEO")} <= keys
    assert not {(1, "OK"), (1, "AM"), (2, "MrNA"), (3, "STOP"), (4, "STAFF")} & keys


def test_alignment_kernels():
    phrase = al.words("the Regional Supply Board of Trade")
    w = al.shortest("RSB", phrase)
    assert (w.first, w.last) == (1, 3)
    assert al.to_the_end("RSBT", phrase).first == 1 and al.to_the_end("RSB", phrase) is None
    assert al.signature("LaTeX") == "LTX" and al.signature("eBay") == "EB"
    assert al.split_compound("sign-on") == ["sign", "on"] and al.split_compound("PowerBI") == ["Power", "BI"]
    assert al.matches_initials("USB", "Universal Serial Bus") and not al.matches_initials("USB", "Universal Bus")
    assert al.windows("", phrase, True, False, False) == []


def test_the_shortest_window_is_the_shortest():
    import random

    rng = random.Random(2)
    for _ in range(200):
        phrase = al.words(" ".join(rng.choice(["Alpha", "Beta", "Gamma", "of", "Delta"]) for _ in range(9)))
        acronym = "".join(rng.choice("ABGD") for _ in range(rng.randrange(1, 4)))
        best = None
        for a in range(9):
            k = 0
            for b in range(a, 9):
                if k < len(acronym) and phrase[b].text[0].upper() == acronym[k] and not phrase[b].is_stop:
                    k += 1
                    if k == len(acronym):
                        if phrase[a].text[0].upper() == acronym[0] and (best is None or b - a < best):
                            best = b - a
                        break
        found = al.windows(acronym, phrase, True, False, False)
        assert (min((w.last - w.first for w in found), default=None)) == best


def test_labels():
    assert al.proper_run("means the European Medicines Agency, which") == "European Medicines Agency"
    assert al.proper_run("see Bank of England and Acme") == "Bank of England and Acme"
    assert al.proper_run("nothing here.") == "nothing here"
    assert al.tighten("the new Portable Document Format", "PDF") == "Portable Document Format"
    assert al.tighten("no such thing.", "PDF") == "no such thing"
    assert al.clean("the Purchase Order", "PO", "inline_before") == "Purchase Order"
    assert al.clean("Order", "O", "inline") is None and al.clean("x " * 200, "X", "def_before") is None


def test_tier_two_context():
    text = "First one. The ABC is here. " + "Third sentence goes on and on for quite a while, to be long enough for a context. End."
    a, b = al.context(text, 15, 18)
    assert a <= 11 and text[a:b].count("ABC") == 1 and b - a >= 80
    a, b = al.context("x" * 1000, 500, 503)
    assert b - a <= 330
    assert al.context("", 0, 0) == (0, 0)


CLEANED = [
    ("The Regional Water Supply Board (RSB) meets.", "RSB", "Regional Supply Board"),
    ("RSB (Regional Water Supply Board) meets.", "RSB", "Regional Supply Board"),
    ("A CPU, short for the common Central Processing Unit, runs.", "CPU", "Central Processing Unit"),
    ("The service-level agreement, abbreviated as SLA, is short.", "SLA", "service-level agreement"),
]


def test_definitions_are_cleaned(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CLEANED)], "doc_id long, text string")
    got = {(r.doc_id, r.key): r.definition for r in extraction.extract(docs).collect()}
    assert {(i, k): got[i, k] for i, (_, k, _) in enumerate(CLEANED)} == {(i, k): d for i, (_, k, d) in enumerate(CLEANED)}


def test_clean_drops_what_is_no_definition():
    assert al.clean("Portable", "P", "inline") is None
    assert al.clean("123 456", "PDF", "def_before") is None
    assert al.clean("word " * 60, "PDF", "inline") is None
    assert al.clean("word " * 60, "PDF", "def_after") is None
    assert al.clean("the Portable Document Format", "PDF", "inline_before") == "Portable Document Format"
