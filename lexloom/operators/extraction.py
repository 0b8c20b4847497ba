"""Definitions of acronyms (EXT): in brackets, by a cue in the sentence, or in a sentence before.

Occurrences are found natively; text and occurrences then pass one Python
function together, out of the same scan, which settles the occurrences, aligns
their surroundings and returns all candidates. The choice among them is an
aggregation of small rows; no text is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import alignment as al
from lexloom.operators import acronyms, meanings

# Reach of the context, confidences and their loss by distance.
LEFT, RIGHT = 320, 280
MOST_PHRASE = 200
BASE = {"parenthetical": 0.95, "inline": 0.80, "sentence_backref": 0.60}
LOSS, LOSS_CHARS = 0.0005, 200
LOOK_BACK = 2
CUES = r"(?:(?:is\s+)?short\s+for|stands?\s+for|means|is\s+(?:an\s+)?acronym\s+for|abbreviated\s+as)"

_CUE_AFTER = re.compile(rf"^(?:['’]s)?\s*,?\s*{CUES}\s+", re.IGNORECASE)
_CUE_BEFORE = re.compile(rf"\s*,?\s*{CUES}\s+[\"“]?$", re.IGNORECASE)
_OPENED = re.compile(r"[(\[]\s*[\"'“”‘’]?\s*$")
_CLOSED = re.compile(r"^\.?[\"'“”‘’]?\s*(?:[,;:—–-][^)\]]{0,120})?[)\]]")
_AFTER_IN_BRACKETS = re.compile(r"^(?:s\b)?(?:['’]s\b)?\s*([(\[])\s*([^)\]]{1,200}?)\s*[)\]]")
_BEFORE_IN_BRACKETS = re.compile(r"[(\[]\s*([^()\[\]]{1,200}?)\s*[)\]]\s+[\"'“”‘’]?$")
_QUOTES = "\"'“”‘’"
_CLAUSE_END = re.compile(r"[.;:](?=\s|$)|[\r\n]")
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n+")


def _clause(text: str) -> tuple[str, int]:
    """What is left of a text behind its last clause boundary, and where it begins."""
    at = 0
    for m in re.finditer(r"[.;:!?](?=\s)|[\r\n()\[\]]", text):
        at = m.end()
    return text[at:], at


def candidates(acronym: str, left: str, right: str, s: int, e: int) -> list[dict]:
    """EXT-01..06, TXT-10: every definition that the surroundings give, cleaned, with the document offsets of what it was cut from."""
    out: list[dict] = []

    def put(text: str, base: int, window: al.Window | None, phrase: list[al.Word], source: str, kind: str) -> None:
        if window is None:
            return
        a, b = phrase[window.first].start, phrase[window.last].end
        definition = al.clean(text[a:b], acronym, kind, MOST_PHRASE)
        if definition and len(definition) > 1 and definition.lower() != acronym.lower():
            gap = min(max(base + a - e, s - base - b, 0), LOSS_CHARS)
            out.append({"definition": definition, "ds": base + a, "de": base + b, "source": source, "conf": round(min(BASE[source] - LOSS * gap, 0.99), 6), "kind": kind})

    start = s - len(left)
    # what the patterns that end here need to stand in front, so that most occurrences needn't be searched
    ahead = left.rstrip()
    if ahead and ahead[-1] in _QUOTES:
        ahead = ahead[:-1].rstrip()
    last = ahead[-1:]
    if last in ("(", "[") and (m := _OPENED.search(left)) and _CLOSED.search(right):
        clause, at = _clause(left[: m.start()])
        phrase = al.words(clause)
        if phrase:
            put(clause, start + at, al.to_the_end(acronym, phrase), phrase, "parenthetical", "def_before")
    if m := _AFTER_IN_BRACKETS.match(right):
        inner, phrase = m.group(2), al.words(m.group(2))
        if phrase:
            put(inner, e + m.start(2), al.shortest(acronym, phrase), phrase, "parenthetical", "def_after")
    if last in (")", "]") and (m := _BEFORE_IN_BRACKETS.search(left)):
        inner, phrase = m.group(1), al.words(m.group(1))
        if phrase:
            put(inner, start + m.start(1), al.shortest(acronym, phrase), phrase, "parenthetical", "paren_before")
    if m := _CUE_AFTER.match(right):
        rest = right[m.end() :]
        stop = _CLAUSE_END.search(rest)
        clause = rest[: stop.start()] if stop else rest
        phrase = al.words(clause)
        if phrase:
            put(clause, e + m.end(), al.shortest(acronym, phrase), phrase, "inline", "inline")
    if ahead[-5:].casefold().endswith(("for", "means", "as")) and (m := _CUE_BEFORE.search(left)):
        clause, at = _clause(left[: m.start()])
        phrase = al.words(clause)
        if phrase:
            put(clause, start + at, al.to_the_end(acronym, phrase), phrase, "inline", "inline_before")
    return out


def look_back(acronym: str, left: str, s: int) -> list[dict]:
    """EXT-11..13: a proper run of words in one of the last sentences before, the nearest first."""
    pieces, at = [], 0
    for m in _SENTENCE_END.finditer(left):
        pieces.append((at, m.start()))
        at = m.end()
    start = s - len(left)
    for back, (a, b) in enumerate(reversed(pieces[-LOOK_BACK:]), 1):
        sentence = left[a:b]
        phrase = al.words(sentence)
        capital = [w for w in phrase if w.text[:1].isupper() or w.is_stop or "-" in w.text]
        if len(phrase) < 2 or len(capital) < 2:
            continue
        found = [w for ws in al.aligned(acronym, phrase) for w in ws]
        found = [w for w in found if len(w.hits) >= 2 and phrase[w.first].text[:1].isupper() and w.last - w.first < 2 * len(acronym)]
        if not found:
            continue
        w = min(found, key=lambda w: (w.last - w.first, w.first))
        x, y = phrase[w.first].start, phrase[w.last].end
        titled = sum(p.text[:1].isupper() for p in phrase[w.first : w.last + 1]) / (w.last - w.first + 1)
        definition = al.clean(sentence[x:y], acronym, "inline", MOST_PHRASE)
        if definition is None:
            continue
        gap = min(s - (start + a + y), LOSS_CHARS)
        conf = BASE["sentence_backref"] - 0.05 * (back - 1) - LOSS * gap + (0.10 if w.last > w.first else 0) + (0.05 if titled >= 0.8 else 0)
        return [{"definition": definition, "ds": start + a + x, "de": start + a + y, "source": "sentence_backref", "conf": round(min(conf, 0.99), 6), "kind": "backref"}]
    return []


def definitions_in(text: str, occurrences: list[dict]) -> list[dict]:
    """EXT-07, EXT-10, EXT-11: every occurrence that stays with its candidates, and the first of a key with those in sentences before.

    Adds first_s, definition, ds, de, source, conf and kind (None without a candidate).
    """
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    firsts: dict[str, int] = {}
    out = []
    for o in acronyms.settle(text, occurrences):
        if o["rule"] is not None:
            continue
        key, s, e = o["key"], o["s"], o["e"]
        found = candidates(key, text[max(0, s - LEFT) : s], text[e : e + RIGHT], s, e)
        if key not in firsts:
            firsts[key] = s
            k = bisect_right(ends, s)
            found += look_back(key, text[ends[k - 1 - LOOK_BACK] if k > LOOK_BACK else 0 : s], s)
        out += [{"key": key, "acronym": o["acronym"], "s": s, "e": e, "first_s": firsts[key], **c} for c in found or [_NOTHING]]
    return out


_NOTHING = {"definition": None, "ds": None, "de": None, "source": None, "conf": None, "kind": None}
_FOUND = "key: string, acronym: string, s: int, e: int, first_s: int, definition: string, ds: int, de: int, source: string, conf: double, kind: string"


def occurrences_with_candidates(docs: DataFrame, dotted: bool = False) -> DataFrame:
    """``definitions_in`` of every text, with its doc_id."""
    return acronyms.by_text(docs, definitions_in, _FOUND, dotted)


def ledger(docs: DataFrame, dotted: bool = False) -> DataFrame:
    """The candidates alone: doc_id, key, acronym, s, e, definition, ds, de, source, conf, kind."""
    return occurrences_with_candidates(docs, dotted).where("definition is not null").drop("first_s")


def picks(rows: DataFrame) -> DataFrame:
    """EXT-08, EXT-14: by key the surest definition at its first occurrence, else the one nearest to it; null without any."""
    there = F.col("s") == F.col("first_s")
    solid = F.col("source") != "sentence_backref"
    order = F.struct((~(there & solid)).alias("a"), F.when(there & solid, F.lit(0)).otherwise(F.col("s") - F.col("first_s")).alias("b"), (-F.col("conf")).alias("c"), (F.col("de") - F.col("ds")).alias("d"), "ds")
    value = F.struct("definition", "ds", "de", "source", "conf", "kind")
    return rows.groupBy("doc_id", "key").agg(F.min_by(value, F.when(F.col("definition").isNotNull(), order)).alias("v")).select("doc_id", "key", "v.*")


def extract(docs: DataFrame, dotted: bool = False) -> DataFrame:
    """EXT-16: one row per document and key: definition, its span, source, confidence and kind, or nulls."""
    return picks(occurrences_with_candidates(docs, dotted))


def meanings_of(docs: DataFrame) -> DataFrame:
    """MNG-01, MNG-02 over what ``ledger`` finds."""
    rows = ledger(docs)
    defs = rows.select("doc_id", "acronym", "definition", "source", "conf", F.col("s").alias("acr_s"), F.col("e").alias("acr_e"), F.col("ds").alias("def_s"), F.col("de").alias("def_e"), F.col("s").alias("seq"))
    return meanings.build(meanings.dedupe(defs))
