"""Acronym detection (DET) and the cleanup of what was found (CLN), in DataFrame operations.

Every gate and score is an expression over the match and a slice of its
surroundings that is cut out next to it, so the text goes nowhere.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.functions import text as fx
from lexloom.operators import domains, spans
from lexloom.session import ship

# The forms of a candidate, in order of precedence, and word lists. The
# repeated groups are possessive, so that Java's matcher runs them as a loop.
FORMS = (
    r"[A-Z0-9]+(?:\s*[&/’'\-–]\s*[A-Z0-9]++\b)++",
    r"[A-Z]{2,}[a-z]{1,3}",
    r"[A-Z][A-Z0-9]{1,9}",
    r"[0-9]+[A-Z][A-Z0-9]{0,8}",
    r"(?:[A-Z][a-z]?){2,5}",
    r"[a-z]{1,2}[A-Z]{2,}[A-Za-z0-9]*",
    r"[A-Z][a-z]{1,}[A-Z][A-Za-z0-9]*",
    r"[a-z]{1,2}[A-Z][a-z]+[A-Za-z0-9]*",
)
DOTTED_FORM = r"[A-Z](?:\.[A-Z])++"
NOT_ACRONYMS = ("OK", "PM", "MR", "MRS", "MS", "DR", "JR", "SR", "LTD", "PLC", "LLP", "LLC", "INC", "YES", "NO", "ON", "OFF")
TWO_LETTERS = ("US", "UK", "EU", "UN")
BLACKLIST = ("AS", "AT", "BE", "BY", "DO", "GO", "IF", "IN", "IS", "OF", "ON", "OR", "SO", "TO", "AN")
THRESHOLDS = {2: 0.72, 3: 0.60, 4: 0.55}
THRESHOLD = 0.50
LEAST, MOST = 2, 10
INLINE_CUES = r"(?i)\b(?:(?:is\s+)?short\s+for|stands?\s+for|means|is\s+(?:an\s+)?acronym\s+for|abbreviated\s+as)\b[\s,;:—–-]"
TIME = r"^(?:[01]?\d|2[0-3])(?::[0-5]\d)?$"

#: What every form begins with; looked for first, as most words fail it at once.
QUICK = r"\b(?=[a-z]{0,2}[A-Z0-9])"
#: Characters of context on either side of a candidate.
REACH = 160


def pattern(dotted: bool = False, mixed: bool = True) -> str:
    forms = list(FORMS if mixed else FORMS[:4])
    if dotted:
        forms.insert(1, DOTTED_FORM)
    return r"\b(?:" + "|".join(forms) + r")\b"


def _upper_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{Lu}", ""))


def accepted(surface: Column, before: Column, after: Column, dotted: bool = False) -> Column:
    """DET-03..05."""
    n = fx.core_length(surface)
    mixed = fx.is_mixed_case(surface)
    uppers = _upper_count(surface)
    least = F.when(mixed & (uppers >= 2), 0.5).when(mixed & (uppers == 1) & surface.rlike(r"^[a-z]{1,2}[A-Z][A-Za-z0-9]*$"), 0.25).otherwise(0.7)
    out = (F.length(surface) >= LEAST) & fx.has_letter(surface) & (n >= LEAST) & (n <= MOST) & (fx.caps_ratio(surface) >= least)
    only = F.replace(surface, F.lit("."), F.lit(""))
    clean = (
        surface.rlike(rf"^{DOTTED_FORM}$")
        & F.length(only).between(LEAST, MOST)
        & ((F.length(only) != 2) | only.isin(*TWO_LETTERS))
        & ~before.rlike(r"[\d.]\z")
        & ~after.rlike(r"^\d")
        & ~after.rlike(r"^\.[^)\]}»”'\" \n\r\t,;:!?…]")
    )
    return out & (~surface.contains(".") | clean)


def in_brackets(before: Column, after: Column) -> tuple[Column, Column]:
    """DET-06: inside and adjacent."""
    return before.rlike(r"[(\[]\z") & after.rlike(r"^[)\]]"), before.rlike(r"[(\[«“]\z") | after.rlike(r"^[)\]»”]")


def defined_in_parens(after: Column) -> Column:
    """DET-07."""
    inner = F.regexp_extract(after, r"^\s*\(([^)]{0,81})\)", 1)
    return F.length(F.regexp_replace(inner, "[^A-Za-z]", "")) >= 5


def stands_for(after: Column) -> Column:
    """DET-08."""
    return F.regexp_extract(after, r"^\s*([^.!?]{0,24})", 1).rlike(r"(?i)\bstands\s+for\b")


def next_lower(after: Column) -> Column:
    """DET-09."""
    word = F.regexp_extract(after, r"""^\s*["'“”‘’(\[{]*([\p{L}']*)""", 1)
    return word.rlike(r"\p{Ll}") & ~word.rlike(r"\p{Lu}")


def previous_token(before: Column) -> Column:
    """DET-09."""
    return F.regexp_extract(before, r"([\p{L}\p{N}:.]*)\s*\z", 1)


def at_sentence_start(before: Column, reaches_start: Column) -> Column:
    """DET-09."""
    return before.rlike(r"""[.!?…][\s")\]}»”’']*\z""") | (reaches_start & before.rlike(r"""^[\s")\]}»”’']*\z"""))


def all_caps_word(surface: Column) -> Column:
    """DET-10."""
    return (F.length(fx.letters(surface)) >= 4) & ~surface.rlike(r"[\d&/’'–-]") & ~surface.rlike(r"[\p{Ll}\p{Lt}\p{Lo}]")


#: What ends the way to an exclamation mark, and that mark.
NEXT_MARK, BANGS = r"[.?\n!！‼]", ("!", "！", "‼")


def shouted(surface: Column, before: Column, after: Column, mark: Column) -> Column:
    """DET-10: an upper-case word after a comma, or after such a word, on the way to an exclamation mark. ``mark``: the next of NEXT_MARK."""
    onwards = after.rlike(r"^\s*(?:[A-Z]{1,2}\s+){0,2}[A-Z]{3,}(?:[^A-Za-z]|$)")
    first = (F.length(surface) >= 4) & before.rlike(r",\s*\z") & onwards
    second = before.rlike(r",\s*\p{Lu}{4,}\s*\z")
    return all_caps_word(surface) & F.coalesce(mark.isin(*BANGS), F.lit(False)) & (first | second)


def heading_line(line: Column) -> Column:
    """DET-10: a whole line of at least six letters, all upper case."""
    return ~line.rlike(r"[\p{Ll}\p{Lt}\p{Lo}]") & (F.length(fx.letters(line)) >= 6)


def dropped_by_context(surface: Column, before: Column, after: Column, reaches_start: Column, in_heading: Column, mark: Column) -> Column:
    """DET-11: the ordered decisions. ``in_heading``: of the match's line, ``mark``: the next of NEXT_MARK."""
    inside, _ = in_brackets(before, after)
    heading = all_caps_word(surface) & in_heading
    start, lower = at_sentence_start(before, reaches_start), next_lower(after)
    i_am = before.rlike(r"""[.!?"'“”‘’(\[{]\s*I\s*\z""") | (reaches_start & before.rlike(r"^\s*I\s*\z"))
    return (
        F.when(inside | defined_in_parens(after) | stands_for(after), False)
        .when(shouted(surface, before, after, mark), True)
        .when(heading, True)
        .when(surface == "IT", start & lower)
        .when(surface == "AM", previous_token(before).rlike(TIME) | i_am)
        .when(~surface.isin(*BLACKLIST, *NOT_ACRONYMS), False)
        .when(surface.isin(*NOT_ACRONYMS) & (after.rlike(r"^\s*[,.!?;:]") | lower), True)
        .otherwise(start & lower)
    )


def score(surface: Column, before: Column, after: Column) -> Column:
    """DET-12."""
    inside, adjacent = in_brackets(before, after)
    value = 0.6 + F.when(inside, 0.25).when(adjacent, 0.15).otherwise(0.0) + F.when(defined_in_parens(after), 0.25).otherwise(0.0) + F.when(stands_for(after), 0.15).otherwise(0.0) - F.when(surface.isin(*BLACKLIST), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def boosted(surface: Column, after: Column, value: Column) -> Column:
    """DET-14."""
    value = F.when(fx.acronym_key(surface).isin(*TWO_LETTERS), F.least(value + 0.75, F.lit(0.99))).otherwise(value)
    cue = F.concat(F.substring(after, 1, 60), F.lit(""))
    return F.when((F.length(surface) <= 3) & cue.rlike(INLINE_CUES), F.least(value + 0.2, F.lit(0.99))).otherwise(value)


def threshold(surface: Column) -> Column:
    """DET-15."""
    n = fx.threshold_length(surface)
    return reduce(lambda w, kv: w.when(n == kv[0], kv[1]), list(THRESHOLDS.items())[1:], F.when(n == 2, THRESHOLDS[2])).otherwise(THRESHOLD)


def reasons(surface: Column, before: Column, after: Column) -> Column:
    """DET-20: tags in their order."""
    inside, adjacent = in_brackets(before, after)
    tags = [
        ("inside_parens", inside),
        ("adjacent_parens", ~inside & adjacent),
        ("paren_definition_right", defined_in_parens(after)),
        ("stands_for_right", stands_for(after)),
        ("blacklist_penalty", surface.isin(*BLACKLIST)),
        ("non_acronym_upper", surface.isin(*NOT_ACRONYMS)),
        ("next_word_lowercase", next_lower(after)),
        ("prev_time_token", previous_token(before).rlike(TIME)),
        ("has_separator", surface.rlike(r"[&/’'–-]")),
    ]
    return F.filter(F.array(*[F.when(on, tag) for tag, on in tags]), lambda x: x.isNotNull())


#: How the surroundings of a candidate are cut out.
_AROUND = {"before": REACH, "after": REACH, "line_flag": heading_line, "next_mark": NEXT_MARK, "spaces": True}


def _core(docs: DataFrame, dotted: bool, with_text: bool = False) -> DataFrame:
    """DET-01..05 of the general forms; with ``with_text`` the row of each text stays in front."""
    rows = spans.matches(docs, QUICK + pattern(dotted), **_AROUND, with_text=with_text)
    taken = accepted(F.col("surface"), F.col("before"), F.col("after"), dotted)
    return rows.where(F.col("surface").isNull() | taken if with_text else taken).drop("nth").withColumn("core", F.lit(True))


def candidates(docs: DataFrame, dotted: bool = False, with_domains: bool = False) -> DataFrame:
    """DET-01..05, DET-13: doc_id, surface, s, e, core and the surroundings.

    Core hits inside a domain's span go; the comparison is of spans of one
    document, joined by doc_id.
    """
    core = _core(docs, dotted)
    if not with_domains:
        return core
    extra = domains.candidates(docs, **_AROUND).drop("nth").where(accepted(F.col("surface"), F.col("before"), F.col("after"), dotted)).dropDuplicates(["doc_id", "s", "e"]).withColumn("core", F.lit(False))
    o = extra.select(F.col("doc_id").alias("_d"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    kept = core.join(o, (core["doc_id"] == o["_d"]) & (o["_s"] <= core["s"]) & (core["e"] <= o["_e"]), "left_anti")
    return kept.unionByName(extra)


def dropped() -> Column:
    """DET-11 over the columns of ``candidates``."""
    return dropped_by_context(*map(F.col, ("surface", "before", "after", "at_start", "flag", "mark")))


def _occurrences(rows: DataFrame, debug: bool = False) -> DataFrame:
    """Candidates as accepted occurrences; rows without a surface stay as they are."""
    surface, before, after = F.col("surface"), F.col("before"), F.col("after")
    is_text = surface.isNull()
    rows = rows.where(is_text | ~dropped())
    rows = rows.withColumn("conf", boosted(surface, after, score(surface, before, after))).where(is_text | (F.col("conf") >= threshold(surface)))
    rows = rows.withColumn("acronym", fx.surface_for_key("surface")).withColumn("key", fx.acronym_key("acronym")).where(is_text | (F.col("key") != ""))
    extra = [reasons(surface, before, after).alias("reasons")] if debug else []
    text = ["text"] if "text" in rows.columns else []
    return rows.select("doc_id", "acronym", "s", "e", F.round("conf", 6).alias("conf"), "key", "core", *extra, *text)


# What follows is the same for texts of ASCII alone, one at a time: most candidates are
# settled by a look at a character or two, where the native plan runs every pattern on every one.

_BEFORE_TOKEN = re.compile(r"([A-Za-z0-9:.]*)\s*\Z", re.ASCII)
_IS_TIME = re.compile(TIME, re.ASCII)
_I_BEFORE, _I_AT_START = re.compile(r"""[.!?"'(\[{]\s*I\s*\Z""", re.ASCII), re.compile(r"\s*I\s*\Z", re.ASCII)
_PARENS = re.compile(r"\s*\(([^)]{0,81})\)", re.ASCII)
_STANDS = re.compile(r"\bstands\s+for\b", re.ASCII | re.IGNORECASE)
_CLOSE_BY = re.compile(r"\s*([^.!?]{0,24})", re.ASCII)
_NEXT_WORD = re.compile(r"""\s*["'(\[{]*([A-Za-z']*)""", re.ASCII)
_STARTS, _STARTS_TEXT = re.compile(r"""[.!?][\s")\]}']*\Z""", re.ASCII), re.compile(r"""[\s")\]}']*\Z""", re.ASCII)
_ONWARDS = re.compile(r"\s*(?:[A-Z]{1,2}\s+){0,2}[A-Z]{3,}(?:[^A-Za-z]|$)", re.ASCII)
_COMMA_BEFORE, _SHOUT_BEFORE = re.compile(r",\s*\Z", re.ASCII), re.compile(r",\s*[A-Z]{4,}\s*\Z", re.ASCII)
_MARK_NEXT, _MARK_AFTER = re.compile(r"[.?\n!]"), re.compile(r"\s*[,.!?;:]", re.ASCII)
_CUED = re.compile(INLINE_CUES, re.ASCII)
_LOWER, _UPPER = re.compile("[a-z]"), re.compile("[A-Z]")
_DOTTED, _DOTTED_ON = re.compile(DOTTED_FORM), re.compile(r"""\d|\.[^)\]}'" \n\r\t,;:!?]""", re.ASCII)
_WHITE = " \t\n\x0b\f\r"


@lru_cache(1 << 16)
def _surface(surface: str) -> tuple[str, str, bool, bool, float, bool] | None:
    """What a surface alone decides: acronym, key, whether it is an all-caps word and one of two letters, its threshold, whether it is listed; None if it can't be one."""
    only = [c for c in surface if c.isalpha()]
    upper, n = sum(c.isupper() for c in only), sum(c.isalnum() for c in surface)
    mixed = 0 < upper < len(only)
    least = 0.5 if mixed and upper >= 2 else 0.25 if mixed and re.match(r"[a-z]{1,2}[A-Z][A-Za-z0-9]*\Z", surface) else 0.7
    if len(surface) < LEAST or not only or not LEAST <= n <= MOST or upper / len(only) < least:
        return None
    if "." in surface:
        plain = surface.replace(".", "")
        if not _DOTTED.fullmatch(surface) or not LEAST <= len(plain) <= MOST or len(plain) == 2 and plain not in TWO_LETTERS:
            return None
    acronym = surface
    for suffix in reversed(fx.PLURAL_SUFFIXES):
        if surface.endswith(suffix):
            stem = surface[: -len(suffix)]
            if "." in stem:
                acronym = surface
            elif _UPPER.search(stem) and not _LOWER.search(stem):
                acronym = stem
    key_of = lambda x: re.sub(r"\s*([&/'-])\s*", r"\1", x.replace(".", ""), flags=re.ASCII)
    acronym = acronym.rstrip(",.;:!?)]}" + _WHITE)
    if not key_of(acronym):
        return None
    caps = len(only) >= 4 and not re.search(r"[\d&/'-]", surface, re.ASCII) and upper == len(only)
    k = max(3, n) if re.search(r"[&/'.-]", surface) else n
    return acronym, key_of(acronym), caps, key_of(surface) in TWO_LETTERS, THRESHOLDS.get(k, THRESHOLD), surface in BLACKLIST or surface in NOT_ACRONYMS or surface in ("IT", "AM")


def _in_ascii(text: str, forms: re.Pattern) -> list[dict]:
    """DET-18 for a text of ASCII alone: what ``detect`` finds in it, in order."""
    found = [m.span() for m in forms.finditer(text)]
    out = []
    for k, (s, e) in enumerate(found):
        surface = text[s:e]
        known = _surface(surface)
        if known is None:
            continue
        acronym, key, caps, two, least, listed = known
        left, right = s, e
        if s and text[s - 1] in _WHITE:
            gap = text[found[k - 1][1] if k else 0 : s]
            run = len(gap) - len(gap.rstrip(_WHITE))
            left = s - run if run > spans.FAR else s
        if e < len(text) and text[e] in _WHITE:
            gap = text[e : found[k + 1][0] if k + 1 < len(found) else len(text)]
            run = len(gap) - len(gap.lstrip(_WHITE))
            right = e + run if run > spans.FAR else e
        before = text[max(left - REACH, 0) : left] + (" " * spans.FAR if left < s else "")
        after = (" " * spans.FAR if right > e else "") + text[right : right + REACH]
        if "." in surface and (before[-1:].isdigit() or before[-1:] == "." or _DOTTED_ON.match(after)):
            continue
        opened, closed = before[-1:] in ("(", "["), after[:1] in (")", "]")
        inside, m = opened and closed, _PARENS.match(after)
        paren = m is not None and sum(c.isalpha() for c in m[1]) >= 5
        stands = _STANDS.search(_CLOSE_BY.match(after)[1]) is not None
        if not (inside or paren or stands):
            if caps:
                mark = _MARK_NEXT.search(text, e)
                if mark and mark[0] == "!" and (_COMMA_BEFORE.search(before) and _ONWARDS.match(after) or _SHOUT_BEFORE.search(before)):
                    continue
                end = text.find("\n", e)
                line = text[text.rfind("\n", 0, e) + 1 : end if end >= 0 else len(text)]
                if not _LOWER.search(line) and len(_UPPER.findall(line)) >= 6:
                    continue
            if listed:
                at_start = left <= REACH
                word = _NEXT_WORD.match(after)[1]
                lower = _LOWER.search(word) is not None and not _UPPER.search(word)
                if surface == "AM":
                    gone = _IS_TIME.search(_BEFORE_TOKEN.search(before)[1]) or _I_BEFORE.search(before) or at_start and _I_AT_START.match(before)
                else:
                    gone = lower and (_STARTS.search(before) or at_start and _STARTS_TEXT.match(before))
                    gone = gone or surface in NOT_ACRONYMS and (lower or _MARK_AFTER.match(after))
                if gone:
                    continue
        conf = 0.6 + (0.25 if inside else 0.15 if opened or closed else 0.0) + (0.25 if paren else 0.0) + (0.15 if stands else 0.0) - (0.2 if surface in BLACKLIST else 0.0)
        conf = max(0.0, min(1.0, conf))
        conf = min(conf + 0.75, 0.99) if two else conf
        if len(surface) <= 3 and _CUED.search(after[:60]):
            conf = min(conf + 0.2, 0.99)
        if conf >= least:
            out.append({"acronym": acronym, "s": s, "e": e, "conf": round(conf, 6), "key": key})
    return out


def _is_ascii() -> Column:
    return F.length("text") == F.octet_length("text")


def detect(docs: DataFrame, dotted: bool = False, with_domains: bool = False, debug: bool = False) -> DataFrame:
    """DET-18: accepted occurrences: doc_id, acronym, s, e, conf, key, core (and reasons)."""
    if with_domains or debug:
        return _occurrences(candidates(docs, dotted, with_domains), debug)
    return by_text(docs, lambda text, found: found, "acronym: string, s: int, e: int, conf: double, key: string", dotted).withColumn("core", F.lit(True))


def by_text(docs: DataFrame, fn: Callable[[str, list[dict]], list[dict]], schema: str, dotted: bool = False) -> DataFrame:
    """What ``fn`` makes of each text and its occurrences, with the row's doc_id.

    Occurrences are found in the same Python pass; in texts with more than
    ASCII, natively before it.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", id_type), *T.StructType.fromDDL(schema).fields]
    types = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    names, forms = types.names[1:], re.compile(QUICK + pattern(dotted), re.ASCII)
    docs = docs.select("doc_id", "text")

    def batch_of(ids: list, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, types.field(0).type), *(pa.array([r[n] for r in rows], types.field(n).type) for n in names)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out = [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := _in_ascii(text, forms):
                    rows = fn(text, found)
                    ids += [doc] * len(rows)
                    out += rows
                if len(out) >= 5_000:
                    yield batch_of(ids, out)
                    ids, out = [], []
        if out:
            yield batch_of(ids, out)

    said = f"doc_id {id_type.simpleString()}, " + ", ".join(p.replace(":", " ", 1) for p in schema.split(","))
    return docs.where(_is_ascii()).mapInArrow(run, said).unionByName(_by_native(docs.where(~_is_ascii()), fn, types, said, dotted))


def _by_native(docs: DataFrame, fn: Callable[[str, list[dict]], list[dict]], types: pa.Schema, said: str, dotted: bool) -> DataFrame:
    """``by_text`` by native patterns.

    A text goes in front of its occurrences out of one scan, in the order in
    which they are found, so it is neither shuffled nor joined, nor repeated
    for each of them.
    """
    rows = _occurrences(_core(docs, dotted, with_text=True)).drop("core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, text, found, out = None, None, [], []

        def done() -> None:
            if found:
                out.extend({"doc_id": doc, **row} for row in fn(text, found))

        for batch in batches:
            for row in batch.to_pylist():
                if row["acronym"] is None:
                    done()
                    doc, text, found = row["doc_id"], row["text"], []
                else:
                    found.append(row)
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return rows.mapInArrow(run, said)


def firsts(occurrences: DataFrame) -> DataFrame:
    """DET-17, CLN-06: the earliest occurrence of each key."""
    value = F.struct("acronym", "s", "e", "conf")
    return occurrences.groupBy("doc_id", "key").agg(F.min_by(value, F.struct("s", "e")).alias("v")).select("doc_id", "key", "v.*")


_PUNCTUATION = ".,;:)]}»”'\""


def _suffix(shorter: str, longer: str) -> bool:
    return len(shorter) < len(longer) and longer.upper().endswith(shorter.upper())


def is_case_typo(acronym: str) -> bool:
    """CLN-05: e.g. NaSA or aBcD."""
    case = "".join("U" if c.isupper() else "l" if c.islower() else "-" for c in acronym if c.isalpha())
    if case.count("U") >= 3 and case.count("l") == 1:
        return len(case) >= 4 and case[0] == "U" and case[-1] != "l"
    return case in ("UlUl", "lUlU")


_OPENS = re.compile(r"\s*\(")
_SHUTS = re.compile(r"\s*\)")
_SPACES = re.compile(r"\s*")


def with_brackets(text: str, occurrences: list[dict]) -> list[dict]:
    """What the rules need to know of the text: a bracket behind an occurrence, what it begins with, where it closes."""
    closing, out = -2, []
    for o in sorted(occurrences, key=lambda o: (o["s"], o["e"])):
        m = _OPENS.match(text, o["e"])
        open_ = m.end() - 1 if m else None
        if m and closing != -1 and closing <= open_:
            closing = text.find(")", open_ + 1)
        out.append(o | {"open": open_, "close": closing if m and closing > 0 else None, "inner": _SPACES.match(text, open_ + 1).end() if m else None, "shut": _SHUTS.match(text, o["e"]) is not None})
    return out


def _letters_by_case(acronym: str) -> tuple[int, int]:
    letters = [c for c in acronym.strip(_PUNCTUATION) if c.isalpha()]
    return sum(c.isupper() for c in letters), sum(c.islower() for c in letters)


def _inside(left: list[dict]) -> set[int]:
    """CLN-01: inside the brackets behind an occurrence whose ending it is."""
    gone, ends, endings = set(), [], Counter()
    waiting = sorted((o for o in left if o["close"] is not None), key=lambda o: o["open"], reverse=True)
    for o in left:  # in the order of their starts: open brackets wait in a heap by where they close
        while waiting and waiting[-1]["open"] < o["s"]:
            x = waiting.pop()
            word = x["acronym"].upper()
            heappush(ends, (x["close"], word))
            endings.update(word[k:] for k in range(1, len(word)))
        while ends and ends[0][0] < o["e"]:
            _, word = heappop(ends)
            endings.subtract(word[k:] for k in range(1, len(word)))
        clean = o["acronym"].strip(_PUNCTUATION)
        if len(clean) > 1 and clean.isalpha() and clean.isupper() and endings[clean] > 0:
            gone.add(o["nth"])
    return gone


def _before_brackets(left: list[dict]) -> set[int]:
    """CLN-02: in front of brackets that hold nothing but a longer one it is the ending of."""
    there: dict[int, dict] = {}
    for x in left:
        if x["s"] not in there or (x["e"], x["conf"]) > (there[x["s"]]["e"], there[x["s"]]["conf"]):
            there[x["s"]] = x
    gone = set()
    for o in left:
        upper, lower = _letters_by_case(o["acronym"])
        if upper + lower < 2 or not (lower == 0 and upper or upper >= 2 and lower) or o["inner"] is None or o["open"] - o["e"] > 2:
            continue
        x = there.get(o["inner"])
        if x is not None and x["shut"] and _suffix(o["acronym"], x["acronym"]):
            gone.add(o["nth"])
    return gone


def _contained(left: list[dict]) -> set[int]:
    """CLN-03: within a wider one whose ending it is."""
    gone, wide = set(), []
    for o in sorted(left, key=lambda o: (o["s"], -o["e"])):
        wide = [x for x in wide if x["e"] > o["s"]]
        if any(o["e"] <= x["e"] and x["e"] - x["s"] > o["e"] - o["s"] and _suffix(o["acronym"], x["acronym"]) for x in wide):
            gone.add(o["nth"])
        wide.append(o)
    return gone


def _same_end(left: list[dict]) -> set[int]:
    """CLN-04: where a longer one ends whose ending it is."""
    by: dict[int, list[dict]] = defaultdict(list)
    for x in left:
        by[x["e"]].append(x)
    return {o["nth"] for o in left if any(_suffix(o["acronym"], x["acronym"]) for x in by[o["e"]])}


#: CLN-01..05 in their order, each over the survivors of those before.
_RULES = (
    ("inside_paren_suffix_of_left", _inside),
    ("token_before_paren_suffix", _before_brackets),
    ("contained_suffix", _contained),
    ("end_suffix_micro", _same_end),
    ("drop_mixed_case_typo", lambda left: {o["nth"] for o in left if is_case_typo(o["acronym"])}),
)


def settle(text: str, occurrences: list[dict]) -> list[dict]:
    """The occurrences of a text in the order of their places, each with the rule that drops it or None."""
    rows = [o | {"nth": k, "rule": None} for k, o in enumerate(with_brackets(text, occurrences))]
    for name, rule in _RULES:
        for k in rule([o for o in rows if o["rule"] is None]):
            rows[k]["rule"] = name
    return rows


def cleaned(docs: DataFrame, dotted: bool = False) -> DataFrame:
    """DET-18 and CLN-01..05, 07 in one scan: occurrences with the rule that drops each, null for those that stay."""

    def rows(text: str, found: list[dict]) -> list[dict]:
        return [{k: o[k] for k in ("acronym", "s", "e", "conf", "key", "rule")} for o in settle(text, found)]

    return by_text(docs, rows, "acronym: string, s: int, e: int, conf: double, key: string, rule: string", dotted)


def cleanup(occurrences: DataFrame, docs: DataFrame) -> DataFrame:
    """CLN-01..05, 07 for occurrences from elsewhere: gathered by document and joined with its text once."""
    ship(docs.sparkSession)
    item = "struct<s:int,e:int,acronym:string,conf:double,key:string>"
    grouped = occurrences.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "acronym", F.col("conf").cast("double").alias("conf"), "key"))).cast(f"array<{item}>").alias("o"))
    rows = grouped.join(docs.select("doc_id", "text"), "doc_id")

    @F.pandas_udf(f"array<{item[:-1]},rule:string>>")
    def dropping(text: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([[{k: x[k] for k in ("s", "e", "acronym", "conf", "key", "rule")} for x in settle(t, list(xs))] for t, xs in zip(text, o)])

    return rows.select("doc_id", F.explode(dropping("text", "o")).alias("v")).select("doc_id", "v.acronym", "v.s", "v.e", "v.conf", "v.key", "v.rule")
