"""Defined terms (TRM): where terms are introduced, mentioned, defined, and what each mention means."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.functions import text as fx
from lexloom.operators import meanings as meaning
from lexloom.operators import spans
from lexloom.session import ship

# The forms of a term and of its introductions. Repeated groups are
# possessive, which Java's matcher runs as a loop: a long run can't exhaust its stack,
# and nothing shorter could go on to match what follows.
_Q, _B = "A-Za-z0-9&/'’.\\-()", "A-Za-z0-9&/'’\\-()"
_BRIDGE = "(?:of|for|to|and|or|the|in|on|at|by|per)"
_QUOTED = f"[A-Z][{_Q}]*+(?:[ \\t]++(?:[A-Z][{_Q}]*+|{_BRIDGE}))*+"
_BARE = f"\\b[A-Z][{_B}]*(?:[ \\t]+(?:[A-Z][{_B}]*|{_BRIDGE}))*"
INTRODUCTIONS = {
    "quoted_means": f'(?i)"{_QUOTED}"[ \\t]+means\\b',
    "quoted_shall_mean": f'(?i)"{_QUOTED}"[ \\t]+shall[ \\t]+mean\\b',
    "parenthetical_alias": f'(?i)\\((?:the[ \\t]+)?"{_QUOTED}"\\)',
}
QUOTED_OCCURRENCE = f'"{_QUOTED}"'
#: Capitalised runs, and what makes one an introduction; searched in Python, in time linear in the text.
_RUN = re.compile(_BARE)
_CAPITALISED = re.compile(_BARE + "\\b")
_BARE_INTRODUCTION = re.compile("[ \\t]+(?:(means)|shall[ \\t]+mean)\\b")
MOST_DEFINITION = 400
CONTEXT = 180
PRIOR_MARGIN, FINAL_MARGIN = 0.20, 0.10
#: Characters on either side of a mention that tier 2 reads.
CONTEXT_CHARS = 180
#: Texts that go through Python together, and their characters but for a longer single one.
AT_ONCE, AT_ONCE_CHARS = 256, 1 << 20


_STARTS_DEFINITION = re.compile(r'"?[ \t]*(?:shall[ \t]+mean|means)[\s,:]*', re.IGNORECASE | re.ASCII)
_ENDS_DEFINITION = re.compile(r"\n\n|[;.]")
_OPENS_ALIAS = re.compile(r"\(\s*(?:the[ \t]+)?\Z", re.IGNORECASE | re.ASCII)
_STOPS = re.compile(r"[.;:\n]")
_LETTER_LED = re.compile(r"[a-z][a-z0-9'-]*")
_BEFORE_BRACKET = re.compile(r"\s*\(", re.ASCII)
_RUN_WORD = re.compile(r"[^ \t]+")


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _term_key(text: str) -> str:
    """TXT-11 for a part of a run, as ``fx.term_key`` has it."""
    folded = text.translate(str.maketrans(fx.APOSTROPHES + fx.DASHES, "'" * len(fx.APOSTROPHES) + "-" * len(fx.DASHES))).strip(" ").strip("\"'")
    plain = " ".join(re.sub(r"[^\w\s-]", "", folded).split())
    return re.sub(r"\s+", "_", plain.lower().replace("-", " "))


class _Spots:
    """Spans of one text, asked whether any overlaps another span."""

    def __init__(self, taken: list[tuple[int, int]]):
        self.taken = sorted(set(taken))
        self.ends = list(accumulate((e for _, e in self.taken), max))

    def meet(self, s: int, e: int) -> bool:
        k = bisect_left(self.taken, (e, -1))
        return k > 0 and self.ends[k - 1] > s


def _exact(text: str, known: dict[str, dict], spots: _Spots) -> Iterator[dict]:
    """TRM-05, 06: whole-word places of each term and its plural after its introduction, clear of all introductions."""
    for key, t in known.items():
        for v in t["variants"]:
            at = text.find(v)
            while at >= 0:
                end = at + len(v)
                whole = not (at and _is_word(text[at - 1])) and not (end < len(text) and _is_word(text[end]))
                if whole and at >= t["first_end"] and not spots.meet(at, end):
                    yield {"term": v, "s": at, "e": end, "key": key}
                at = text.find(v, end)


def _in_runs(text: str, known: dict[str, dict], spots: _Spots) -> Iterator[dict]:
    """TRM-08: capitalised runs that hold a known term: all of it, else its longest known end, else its longest known beginning.

    Every word of a run gives its key a part, so no part of a run with more
    words than the longest known key has parts can be known.
    """
    most = max((key.count("_") + 1 for key in known), default=0)
    for run in _CAPITALISED.finditer(text):
        if _BEFORE_BRACKET.match(text, run.end()):
            continue
        words = [m.span() for m in _RUN_WORD.finditer(text, *run.span())]
        n = len(words)
        tries = [(0, n)] if n <= most else []
        tries += [(n - size, n) for size in range(min(n - 1, most), 0, -1)] + [(0, size) for size in range(min(n - 1, most), 0, -1)]
        for a, b in tries:
            s, e = words[a][0], words[b - 1][1]
            key = _term_key(text[s:e])
            if key in known:
                if s >= known[key]["first_end"] and not spots.meet(s, e):
                    yield {"term": text[s:e], "s": s, "e": e, "key": key}
                break


def _variants(term: str) -> list[str]:
    """TXT-23, as ``fx.term_variants`` has it."""
    if term.endswith("y") and len(term) > 1 and term[-2].lower() not in fx.VOWELS:
        return [term, term[:-1] + "ies"]
    return [term, term + ("es" if term.endswith(("s", "x", "z", "ch", "sh")) else "s")]


def _bare_introductions(text: str) -> Iterator[dict]:
    """TRM-02: capitalised runs that mean something without quotes."""
    for run in _RUN.finditer(text):
        if m := _BARE_INTRODUCTION.match(text, run.end()):
            term = run.group()
            yield {"term": term, "s": run.start(), "e": run.end(), "key": _term_key(term), "kind": "bare_means" if m[1] else "bare_shall_mean", "variants": _variants(term)}


def _meaning(text: str, intro: dict, stops: list[int]) -> tuple[str | None, str | None]:
    """TRM-09, 11, 12: the definition, or the antecedent of an alias."""
    if intro["kind"] == "parenthetical_alias":
        end = intro["s"] - 1
        opened = _OPENS_ALIAS.search(text, max(0, end - 200), end)
        end = opened.start() if opened else end
        k = bisect_left(stops, end)
        return None, text[stops[k - 1] + 1 if k else 0 : end].strip() or None
    rest = text[intro["e"] : intro["e"] + MOST_DEFINITION + 60]
    begun = _STARTS_DEFINITION.match(rest)
    body = rest[begun.end() :] if begun else rest
    ended = _ENDS_DEFINITION.search(body)
    return body[: ended.start() if ended else None][:MOST_DEFINITION].strip() or None, None


#: The patterns of quotes, as Java reads them: letters without case in ASCII alone, word ends by any letter or digit.
_QUOTED_INTRODUCTIONS = {kind: re.compile(p.replace("\\b", "(?u:\\b)"), re.ASCII) for kind, p in INTRODUCTIONS.items()}
_QUOTED_AGAIN = re.compile(QUOTED_OCCURRENCE)


def _introductions(text: str, unquoted: bool) -> list[dict]:
    """TRM-01, 02: in the order of their places."""
    out = list(_bare_introductions(text)) if unquoted else []
    for kind, pattern in _QUOTED_INTRODUCTIONS.items():
        for m in pattern.finditer(text):
            s = text.index('"', m.start()) + 1
            e = text.index('"', s)
            out.append({"term": text[s:e], "s": s, "e": e, "key": _term_key(text[s:e]), "kind": kind, "variants": _variants(text[s:e])})
    return sorted(out, key=lambda i: (i["s"], i["e"], i["kind"]))


def _mentions(text: str, intros: list[dict], unquoted: bool) -> list[tuple[str, int, int, str]]:
    """TRM-05..08: term, s, e and key in the order of their places."""
    known: dict[str, dict] = {}
    for i in intros:
        t = known.setdefault(i["key"], {"variants": i["variants"], "first_end": i["e"]})
        t["first_end"] = min(t["first_end"], i["e"])
    spots, own = _Spots([(i["s"], i["e"]) for i in intros]), {(i["s"], i["e"]) for i in intros}
    found: dict[tuple, tuple] = {}

    def put(at: tuple[int, int], value: tuple[str, str]) -> None:
        found[at] = min(found.get(at, value), value)

    for m in (*intros, *_exact(text, known, spots)):
        put((m["s"], m["e"]), (m["term"], m["key"]))
    for q in _QUOTED_AGAIN.finditer(text):
        at, term = (q.start() + 1, q.end() - 1), q.group()[1:-1]
        key = _term_key(term)
        if key in known and at[0] >= known[key]["first_end"] and at not in own:
            put(at, (term, key))
    for m in _in_runs(text, known, spots) if unquoted else ():
        found.setdefault((m["s"], m["e"]), (m["term"], m["key"]))
    return [(t, s, e, k) for (s, e), (t, k) in sorted(found.items())]


def _meanings(text: str, intros: list[dict]) -> list[dict]:
    """TRM-09, 11, 12: numbered by key."""
    stops = [m.start() for m in _STOPS.finditer(text)] if any(i["kind"] == "parenthetical_alias" for i in intros) else []
    ordinals, out = Counter(), []
    for i in intros:
        definition, antecedent = _meaning(text, i, stops)
        nth = ordinals[i["key"]]
        out.append({k: i[k] for k in ("term", "key", "kind", "s", "e")} | {"ordinal": nth, "definition": definition, "antecedent": antecedent, "meaning_id": f"{i['term']}|{i['key']}|{nth}"})
        ordinals[i["key"]] += 1
    return out


def _over_texts(docs: DataFrame, schema: str, fn: Callable[[list[str]], Iterable[list[tuple]]]) -> DataFrame:
    """The rows that ``fn`` makes of each of some texts, with the doc_id of the text's row.

    Texts are read, searched and settled in one Python pass out of the scan:
    nothing is shuffled or joined, and rows are of one text, whatever its id.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    fields = T.StructType.fromDDL(schema).fields
    types = pa.schema([("doc_id", to_arrow_type(id_type)), *((f.name, to_arrow_type(f.dataType)) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and end - at < AT_ONCE and (end == at or chars + len(texts[end]) <= AT_ONCE_CHARS):
                    chars += len(texts[end])
                    end += 1
                owners: list[int] = []
                rows: list[tuple] = []
                for i, made in enumerate(fn(texts[at:end]), at):
                    owners += [i] * len(made)
                    rows += made
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int32())).cast(types.field(0).type), *(pa.array(c, t.type) for c, t in zip(zip(*rows), list(types)[1:]))], schema=types)
                at = end

    return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, f"doc_id {id_type.simpleString()}, {schema}")


def introductions(docs: DataFrame, unquoted: bool = False) -> DataFrame:
    """TRM-01..04: doc_id, term, s, e, key, kind. Bare introductions only where ``unquoted``."""

    def rows(texts: list[str]) -> Iterator[list[tuple]]:
        for text in texts:
            yield [(i["term"], i["s"], i["e"], i["key"], i["kind"]) for i in _introductions(text, unquoted)]

    return _over_texts(docs, "term string, s int, e int, key string, kind string", rows)


def mentions(docs: DataFrame, unquoted: bool = False) -> DataFrame:
    """TRM-05..08: introductions, exact later references (term or plural), quoted ones and, if asked, unquoted ones: doc_id, term, s, e, key."""

    def rows(texts: list[str]) -> Iterator[list[tuple]]:
        for text in texts:
            intros = _introductions(text, unquoted)
            yield _mentions(text, intros, unquoted) if intros else []

    return _over_texts(docs, "term string, s int, e int, key string", rows)


def definitions(docs: DataFrame, unquoted: bool = False) -> DataFrame:
    """TRM-09, 11, 12: the meanings, numbered by key, with the definition or the antecedent of an alias."""
    names = ("term", "key", "kind", "s", "e", "ordinal", "definition", "antecedent", "meaning_id")

    def rows(texts: list[str]) -> Iterator[list[tuple]]:
        for text in texts:
            yield [tuple(m[k] for k in names) for m in _meanings(text, _introductions(text, unquoted))]

    return _over_texts(docs, "term string, key string, kind string, s int, e int, ordinal int, definition string, antecedent string, meaning_id string", rows)


_APPENDED = "(?i)^(schedule|appendix|annex)\\s+([A-Za-z0-9]+)\\b"
_SECTION = "(?i)^(?:(?:section|clause)\\s+)?(\\d+(?:\\.\\d+)*)\\b"


def sections(docs: DataFrame) -> DataFrame:
    """TRM-10: sections with their paths: doc_id, s, e (null at the end), path.

    A schedule, appendix or annex heading starts its own branch, which the
    numbered headings after it belong to.
    """
    rows = spans.lines(docs)
    branch = F.when(F.col("line").rlike(_APPENDED), F.concat_ws(":", F.lower(F.regexp_extract("line", _APPENDED, 1)), F.lower(F.regexp_extract("line", _APPENDED, 2))))
    number = F.when(branch.isNull() & F.col("line").rlike(_SECTION), F.concat(F.lit("section:"), F.regexp_extract("line", _SECTION, 1)))
    rows = rows.select("doc_id", "s", branch.alias("branch"), number.alias("number")).where("branch is not null or number is not null")
    order = Window.partitionBy("doc_id").orderBy("s")
    current = F.last("branch", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", "s", F.lead("s").over(order).alias("e"), F.filter(F.array(current, F.col("number")), lambda x: x.isNotNull()).alias("path"))


def with_path(rows: DataFrame, sections: DataFrame, at: str = "s") -> DataFrame:
    """TRM-10: the path at an offset, ``document`` before any section.

    An as-of join by one merged timeline: rows and sections of a document are
    ordered together and the last section is carried forward.
    """
    columns = rows.columns
    left = rows.select(F.struct(*columns).alias("_row"), F.col("doc_id").alias("_d"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("array<string>").alias("_path"))
    right = sections.select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col("doc_id").alias("_d"), F.col("s").alias("_at"), F.lit(0).alias("_kind"), F.col("path").alias("_path"))
    order = Window.partitionBy("_d").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = left.unionByName(right).withColumn("_p", F.last("_path", ignorenulls=True).over(order)).where("_kind = 1")
    return merged.select("_row.*", F.coalesce("_p", F.array(F.lit("document"))).alias("path"))


#: What Java's ``(?U)\\s`` counts as white space, and the headings of sections as Java's patterns find them.
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_APPENDED_LINE, _SECTION_LINE = (re.compile(p.replace("\\b", "(?u:\\b)"), re.ASCII) for p in (_APPENDED, _SECTION))


def _paths(text: str) -> tuple[list[int], list[tuple[str, ...]]]:
    """TRM-10 for one text: where its sections begin and their paths, as ``sections`` has them; ``document`` before any."""
    starts, paths, branch, at = [-1], [("document",)], None, 0
    for raw in text.split("\n"):
        line = raw.strip(_WHITE)
        if line and (line[0].isdigit() or line[0] in "aAcCsS"):
            number = None
            if m := _APPENDED_LINE.search(line):
                branch = f"{m[1].lower()}:{m[2].lower()}"
            elif m := _SECTION_LINE.search(line):
                number = f"section:{m[1]}"
            if m:
                starts.append(at + len(raw) - len(raw.lstrip(_WHITE)))
                paths.append(tuple(x for x in (branch, number) if x))
        at += len(raw) + 1
    return starts, paths


def _rounded(x: float) -> float:
    """To six digits, half up by the number as it is written, as Spark rounds."""
    return float(Decimal(repr(x)).quantize(_SIXTH, ROUND_HALF_UP))


_SIXTH = Decimal("0.000001")


def _scored(text: str, unquoted: bool) -> list[tuple[tuple, list[tuple]]]:
    """TRM-13: every mention (term, key, s, e) of a text with score, place and meaning of each meaning of its key: five additive parts."""
    intros = _introductions(text, unquoted)
    if not intros:
        return []
    starts, paths = _paths(text)
    path = lambda at: paths[bisect_left(starts, at + 1) - 1]
    of: dict[str, list[tuple]] = {}
    for m in _meanings(text, intros):
        words = set(_LETTER_LED.findall((m["definition"] if m["definition"] is not None else m["antecedent"] or "").lower()))
        of.setdefault(m["key"], []).append((m["s"], path(m["s"]), words, 1.0 if m["definition"] is not None else 0.4 if m["kind"] == "parenthetical_alias" else 0.0, m))
    out = []
    for term, s, e, key in _mentions(text, intros, unquoted):
        here, near, tried = path(s), set(_LETTER_LED.findall(text[max(0, s - CONTEXT) : e + CONTEXT].lower())), []
        for ms, there, words, kind, m in of[key]:
            gap = abs(s - ms)
            distance = 1.0 if gap <= 250 else 0.7 if gap <= 1000 else 0.35 if gap <= 5000 else 0.1
            section = 1.0 if here == there else 0.5 if here[0] == there[0] else 0.0
            overlap = len(words & near) / len(words) if words else 0.0
            tried.append((_rounded((1.0 if s >= ms else -0.25) + distance + section + overlap + kind), ms, m))
        out.append(((term, key, s, e), tried))
    return out


def scores(docs: DataFrame, unquoted: bool = False) -> DataFrame:
    """TRM-13: every mention with every meaning of its key: doc_id, term, key, s, e, meaning_id, meaning_s, score."""

    def rows(texts: list[str]) -> Iterator[list[tuple]]:
        for text in texts:
            yield [(*mention, m["meaning_id"], ms, score) for mention, tried in _scored(text, unquoted) for score, ms, m in tried]

    return _over_texts(docs, "term string, key string, s int, e int, meaning_id string, meaning_s int, score double", rows)


def _resolved(tried: list[tuple]) -> tuple[int, float, str, str | None, str]:
    """TRM-14, TRM-16 for one mention: candidates, margin, the tier-1 choice (an earlier meaning within the margin), the final one (only beyond its margin) and the method."""
    ranked = sorted((-score, ms, m["meaning_id"]) for score, ms, m in tried)
    top, best = -ranked[0][0], ranked[0][2]
    scale = max(abs(top), 1.0)
    margin = (top + ranked[1][0]) / scale if len(ranked) > 1 else 1.0
    first = best if margin >= PRIOR_MARGIN else min((ms, i) for neg, ms, i in ranked if (top + neg) / scale < PRIOR_MARGIN)[1]
    final = best if len(ranked) == 1 or margin >= FINAL_MARGIN else None
    return len(ranked), _rounded(margin), first, final, "unresolved" if final is None else "tier1"


_RESOLVED = "term string, key string, s int, e int, n_candidates int, margin double, tier1_meaning string, meaning_id string, method string"


def resolutions(docs: DataFrame, unquoted: bool = False) -> DataFrame:
    """TRM-14, TRM-16: each mention with its tier-1 and its final choice."""

    def rows(texts: list[str]) -> Iterator[list[tuple]]:
        for text in texts:
            yield [(*mention, *_resolved(tried)) for mention, tried in _scored(text, unquoted)]

    return _over_texts(docs, _RESOLVED, rows)


def _reason(tried: list[tuple], resolved: tuple, mode: str, only_undecided: bool, ceiling: float) -> str | None:
    """TRM-15 for one mention, as ``meanings.route_terms`` decides."""
    n, margin, first = resolved[:3]
    if mode == "off":
        return "disabled"
    if n < 2:
        return "single_candidate"
    if only_undecided and first is not None:
        return "tier1_decided"
    if mode == "auto" and margin >= ceiling:
        return "tier1_confident"
    return None if all(m["definition"] for _, _, m in tried) else "no_meanings"


def route(docs: DataFrame, mode: str = "auto", only_undecided: bool = False, ceiling: float = meaning.TIER2_CEILING, unquoted: bool = False) -> DataFrame:
    """TRM-15: mentions with the ``reason`` why tier 2 leaves them alone, null where it doesn't."""

    def rows(texts: list[str]) -> Iterator[list[tuple]]:
        for text in texts:
            each = [(mention, tried, _resolved(tried)) for mention, tried in _scored(text, unquoted)]
            yield [(*mention, *r[:3], _reason(tried, r, mode, only_undecided, ceiling)) for mention, tried, r in each]

    return _over_texts(docs, "term string, key string, s int, e int, n_candidates int, margin double, meaning_id string, reason string", rows)


def _similar(a: np.ndarray, b: np.ndarray) -> float:
    """T2-05, summed in the order of the entries, as ``meanings.cosine01`` does."""
    dot = lambda x, y: float(np.cumsum(x * y)[-1]) if len(x) else 0.0
    n = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return min(max(0.5 * ((dot(a, b) / n if n else 0.0) + 1.0), 0.0), 1.0)


def resolve(docs: DataFrame, analysed: Analysed, model, weight: float = meaning.TIER2_WEIGHT, mode: str = "auto", only_undecided: bool = False, ceiling: float = meaning.TIER2_CEILING, batch: int = 64) -> DataFrame:
    """TRM-15, TRM-16: the final resolutions; those of reranked mentions are by blended scores (``tier2_blend``), the others as tier 1 left them.

    Scores of mentions without a reason are blended with the similarity of
    context and ``term: definition``. The texts are analysed anew, as
    ``analysed`` was; ``batch`` distinct texts of some documents go to a call
    of the model.
    """
    unquoted = analysed.unquoted

    def rows(texts: list[str]) -> Iterator[list[tuple]]:
        found, wanted = [], {}
        for text in texts:
            found.append([])
            for mention, tried in _scored(text, unquoted):
                first, around, said = _resolved(tried), None, []
                if _reason(tried, first, mode, only_undecided, ceiling) is None:
                    term, _, s, e = mention
                    around, said = text[max(0, s - CONTEXT_CHARS) : e + CONTEXT_CHARS], [f"{term}: {m['definition']}" for _, _, m in tried]
                    wanted |= dict.fromkeys((around, *said))
                found[-1].append((mention, tried, first, around, said))
        order = list(wanted)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            wanted |= dict(zip(part, np.asarray(model(part), np.float32).astype(np.float64)))
        for each in found:
            out = []
            for mention, tried, first, around, said in each:
                n, margin, tier1, final, method = first
                if around is not None:
                    blended = [(_rounded((1 - weight) * score + weight * _similar(wanted[around], wanted[t])), ms, m) for (score, ms, m), t in zip(tried, said)]
                    _, margin, _, final, method = _resolved(blended)
                    method = "unresolved" if final is None else "tier2_blend"
                out.append((*mention, n, margin, tier1, final, method))
            yield out

    return _over_texts(docs, _RESOLVED, rows)


class Analysed(dict):
    """The parts of an analysis by name, and whether it takes unquoted terms."""

    unquoted = False


def analyse(docs: DataFrame, unquoted: bool = False) -> Analysed:
    """TRM-17: introductions, mentions, meanings, sections, scores and resolutions, each in one pass over the texts."""
    parts = {"introductions": introductions, "mentions": mentions, "meanings": definitions, "scores": scores, "resolutions": resolutions}
    out = Analysed({name: part(docs, unquoted) for name, part in parts.items()} | {"sections": sections(docs.select("doc_id", "text"))})
    out.unquoted = unquoted
    return out
