"""PII removal with information-theoretic sanitisation.

Protected entities are found by fixed patterns (email, ip, card, phone). Any
word of the same document may reveal an entity, and the corpus tells how much:
with n documents, an entity e in n_e of them, a term t in n_t and both in n_te,
knowing t discloses

    PMI(e; t) / IC(e) = 1 - log(n_t / n_te) / log(n / n_e)

of e's information. No pair is left out for being rare: one seen together in
fewer than ``SUPPORT`` documents is counted as if one more document held the
term without the entity (n_t + 1). A term that discloses ``DISCLOSED`` or more
is a span of its own (``term``), wherever it stands in a document that holds
the entity it reveals. ``sanitise`` generalises entities to their kind and
removes such terms.

Counts cover the whole corpus and whole texts. As n_te is at most n_e, a pair
whose n_t is too large for its n_e can't disclose enough and needs no n_te; two
arrays of ``2**LEVEL_BITS`` bytes (a fixed size whatever the input) bound n_t
from below and n_e from above, so that such pairs are never made. What is left
is joined on full hashes and judged by exact counts.

Defined results: null and empty texts have no spans; matches that fail their
check (part over 255, digits out of range, Luhn) are dropped without a retry;
rows that repeat a ``doc_id`` are searched each on its own, rows that repeat
id and text count as one document of the corpus in all four counts; bytes that
are no UTF-8 read as U+FFFD; other columns are ignored (and kept by
``sanitise``).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textops as tx
from lexloom.session import checkpoint_dir

KINDS = ("email", "ip", "card", "phone")
#: Letters that a term has at least.
TERM_LETTERS = 3
#: Documents together from which a pair's counts are taken as they are.
SUPPORT = 3
DISCLOSED = 0.9
LEVEL_BITS = 24
#: Levels to a doubling of a count.
LEVELS = 8
TERM = "term"

# An address is found from its @: what may stand before is a run that holds no @.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Whole digit runs, so that a long run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_LUHN = str.maketrans("0123456789", "0246813579")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    doubled = digits[-2::-2].translate(_LUHN)
    return sum(map(int, digits[-1::-2] + doubled)) % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Entities by kind as in ``KINDS``, then by start; offsets in code points."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group()) if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _value(kind: str, text: str) -> str:
    """What makes two mentions the same entity."""
    return f"{kind}:{text.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', text)}"


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _terms(text: str, spans: list[tuple[str, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Places of each term of the text, outside all entities."""
    taken, k = sorted((a, b) for _, a, b in spans), 0
    ends = list(accumulate((b for _, b in taken), max))
    out: dict[str, list[tuple[int, int]]] = {}
    for m in _WORD.finditer(text):
        s, e = m.span()
        while k < len(taken) and ends[k] <= s:
            k += 1
        if e - s >= TERM_LETTERS and not (k < len(taken) and taken[k][0] < e):
            out.setdefault(m.group().lower(), []).append((s, e))
    return out


def _entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    return sorted({_hash(_value(kind, text[a:b])) for kind, a, b in spans})


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Every entity of the text with every term and its places."""
    terms = _terms(text, spans)
    return [{"entity": entity, "term": _hash(word), "s": s, "e": e} for entity in _entities(text, spans) for word, places in terms.items() for s, e in places]


def _render(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entities(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, _key, counts by kind, base spans as text and its distinct entities."""
    types = {"n_email": pa.int64(), "n_ip": pa.int64(), "n_card": pa.int64(), "n_phone": pa.int64(), "base": pa.string(), "entities": pa.list_(pa.int64())}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {k: [] for k in types}
        for text in tx.strings(tx.column(batch, "text")):
            spans = base_spans(text or "")
            for kind in KINDS:
                rows[f"n_{kind}"].append(sum(k == kind for k, _, _ in spans))
            rows["base"].append(_render(spans))
            rows["entities"].append(_entities(text, spans) if spans else [])
        return tx.to_batch({"doc_id": tx.column(batch, "doc_id"), "_key": tx.column(batch, "_key")} | rows, types)

    table = tx.id_and_text(docs).withColumn("_key", F.xxhash64("doc_id", "text"))
    return table.mapInArrow(tx.per_chunk(run), "doc_id long, _key long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<bigint>")


def _levels(counts: DataFrame, key: str, n: str, upper: bool) -> np.ndarray:
    """By slot of the key's hash, LEVELS * log2 of the counts there: none is over (``upper``) or none under."""
    block = 1 << 16

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        levels = np.zeros(block, np.uint8)
        levels[table.column("slot").to_numpy() % block] = table.column("level").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary())})

    level = F.log2(F.col(n).cast("double")) * LEVELS
    # a step of room for rounding
    level = F.least(F.ceil(level) + 1, F.lit(255)) if upper else F.greatest(F.floor(level) - 1, F.lit(0))
    slots = counts.select((F.col(key).bitwiseAND((1 << LEVEL_BITS) - 1)).cast("int").alias("slot"), level.cast("int").alias("level"))
    slots = slots.groupBy("slot").agg((F.max if upper else F.min)("level").alias("level"))
    rows = slots.groupBy(F.floor(F.col("slot") / block).cast("int").alias("block")).applyInArrow(gather, "block int, levels binary").toArrow()
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    for k, levels in zip(rows.column("block").to_pylist(), rows.column("levels")):
        out[k * block : (k + 1) * block] = np.frombuffer(levels.as_py(), np.uint8)
    return out


def _document_counts(docs: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """(term, n_t): documents that hold the term.

    Every row counts 1; the documents of ``repeats`` (doc_id, _key, n) are then
    counted 1 - n more, so that rows that repeat id and text are one document
    and no text is shuffled but theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"term": pa.int64(), "n_t": pa.int64()}
        counts: dict[str, int] = {}
        for batch in batches:
            for text, weight in zip(tx.strings(tx.column(batch, "text")), tx.column(batch, "weight").to_pylist()):
                for word in {w.lower() for w in set(_WORD.findall(text or "")) if len(w) >= TERM_LETTERS}:
                    counts[word] = counts.get(word, 0) + weight
                if len(counts) > 500_000:
                    yield tx.to_batch({"term": [_hash(w) for w in counts], "n_t": list(counts.values())}, types)
                    counts = {}
        if counts:
            yield tx.to_batch({"term": [_hash(w) for w in counts], "n_t": list(counts.values())}, types)

    table = tx.id_and_text(docs)
    weighed = table.select("text", F.lit(1).cast("long").alias("weight"))
    if repeats is not None:
        again = repeats.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), (1 - F.col("n")).alias("weight"))
        keyed = table.withColumn("_key", F.xxhash64("doc_id", "text"))
        more = keyed.join(again, keyed["doc_id"].eqNullSafe(again["_d"]) & (keyed["_key"] == again["_k"])).dropDuplicates(["doc_id", "_key"])
        weighed = weighed.unionByName(more.select("text", "weight"))
    return weighed.mapInArrow(run, "term long, n_t long").groupBy("term").agg(F.sum("n_t").alias("n_t"))


def _candidates(docs: DataFrame, terms: np.ndarray, alone: np.ndarray, n: int, disclosed: float) -> DataFrame:
    """Per document and term: the entities there that the term may disclose enough of, and its places. ``terms``, ``alone``: levels of n_t and n_e."""
    slot = (1 << LEVEL_BITS) - 1
    shared = docs.sparkSession.sparkContext.broadcast((terms, alone))
    types = {"doc_id": pa.int64(), "_key": pa.int64(), "term": pa.int64(), "entities": pa.list_(pa.int64()), "places": pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))}
    whole = LEVELS * math.log2(max(n, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_t, n_e = shared.value
            rows: dict[str, list] = {k: [] for k in types}
            size = 0
            for i, key, text in zip(tx.column(batch, "doc_id").to_pylist(), tx.column(batch, "_key").to_pylist(), tx.strings(tx.column(batch, "text"))):
                spans = base_spans(text or "")
                if not spans:
                    continue
                # n_t <= n_e * (n / n_e) ** (1 - disclosed), in levels
                some = _entities(text, spans)
                most = [disclosed * float(n_e[e & slot]) + (1 - disclosed) * whole if disclosed >= 0 else math.inf for e in some]
                most, some = map(list, zip(*sorted(zip(most, some))))
                for word, places in _terms(text, spans).items():
                    term = _hash(word)
                    near = some[bisect_left(most, float(n_t[term & slot])) :]
                    if not near:
                        continue
                    for k, v in zip(types, (i, key, term, near, [{"s": s, "e": e} for s, e in places])):
                        rows[k].append(v)
                    size += len(near) + len(places)
                    if size > 200_000:
                        yield tx.to_batch(rows, types)
                        rows, size = {k: [] for k in types}, 0
            if rows["term"]:
                yield tx.to_batch(rows, types)

    table = tx.id_and_text(docs).withColumn("_key", F.xxhash64("doc_id", "text"))
    return table.mapInArrow(run, "doc_id long, _key long, term long, entities array<bigint>, places array<struct<s: int, e: int>>")


def _disclosing(docs: DataFrame, found: DataFrame, support: int, disclosed: float) -> tuple[DataFrame, DataFrame]:
    """(entity, term) of every term that discloses so much of an entity, and the rows of ``_candidates``."""
    alone = found.where(F.size("entities") > 0).select("doc_id", "_key", "entities").distinct()
    alone = alone.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).checkpoint()
    documents = found.groupBy("doc_id", "_key").agg(F.count("*").alias("n"))
    n, repeated = documents.agg(F.count("*"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0))).first()
    counts = _document_counts(docs, documents.where("n > 1") if repeated else None).checkpoint()
    near = _candidates(docs, _levels(counts, "term", "n_t", False), _levels(alone, "entity", "n_e", True), n, disclosed)
    # rows that repeat id and text are one document
    near = near.dropDuplicates(["doc_id", "_key", "term"]).checkpoint()
    together = near.select("term", F.explode("entities").alias("entity")).groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    joined = together.join(counts, "term").join(alone, "entity")
    n_t = F.col("n_t") + (F.col("n_te") < support).cast("long")
    part = 1 - F.log(F.greatest(n_t / F.col("n_te"), F.lit(1.0))) / F.log(F.lit(float(n)) / F.col("n_e"))
    return joined.where((F.col("n_e") < n) & (part >= disclosed)).select("entity", "term"), near


def disclosures(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """(entity, term) of every term that discloses so much of an entity. ``found``: of ``entities``."""
    checkpoint_dir(docs.sparkSession)
    return _disclosing(docs, found, support, disclosed)[0]


def _with_terms(docs: DataFrame, support: int, disclosed: float) -> DataFrame:
    """``entities`` with the places of disclosing terms, sorted, as ``terms``."""
    checkpoint_dir(docs.sparkSession)
    found = entities(docs).checkpoint()
    pairs, near = _disclosing(docs, found, support, disclosed)
    places = near.select("doc_id", "_key", "term", F.explode("entities").alias("entity"), "places").join(pairs, ["entity", "term"], "left_semi")
    places = places.groupBy("doc_id", "_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("terms"))
    places = places.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "terms")
    return found.join(places, found["doc_id"].eqNullSafe(places["_d"]) & (found["_key"] == places["_k"]), "left").drop("_d", "_k", "entities")


def find(docs: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base_sha256, all spans and the number of terms."""
    rows = _with_terms(docs, support, disclosed)
    terms = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit(TERM), t["s"].cast("string"), t["e"].cast("string"))), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), terms)
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with entities generalised to their kind and terms removed; overlapping spans go as one."""
    out, left, put = [], 0, -1
    for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
        if a >= put:
            out.append(text[left:a] if a > left else "")
            out.append("[TERM]" if kind == TERM else f"[{kind.upper()}]")
        left = put = max(left, b)
    return "".join([*out, text[left:]])


def sanitise(docs: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """``docs`` with the spans of each text replaced; every other column as it came, but ``n_chars`` of changed texts."""
    found = _with_terms(docs, support, disclosed).where("base != ''")
    spans = found.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), F.struct("base", "terms").alias("_spans")).dropDuplicates(["_d", "_k"])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")).alias("_key"))
    joined = rows.join(spans, rows["_id"].eqNullSafe(spans["_d"]) & (rows["_key"] == spans["_k"]), "left").select("_row", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = tx.column(batch, "_row")
            rows = pa.RecordBatch.from_arrays(row.flatten(), names=[f.name for f in row.type])
            texts, changed = tx.strings(tx.column(rows, "text")), []
            for i, one in enumerate(tx.column(batch, "_spans").to_pylist()):
                if one:
                    base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in one["base"].split(","))]
                    texts[i] = redact(texts[i], base + [(TERM, t["s"], t["e"]) for t in one["terms"] or ()])
                    changed.append(i)
            yield tx.with_texts(rows, texts, changed)

    return joined.mapInArrow(run, docs.schema)
