"""Acronym meanings and the disambiguation of occurrences (MNG), and the tier-2 rerank (T2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as fx

# Precedence of sources, weights and margins.
SOURCES = {"parenthetical": 5, "inline": 4, "first_occurrence_anchored": 3, "all_occ_scan_parenthetical": 2, "sentence_backref": 1}
NEAR_TIE = 0.06
DISTANCE_WEIGHT, OVERLAP_WEIGHT, PRIOR_WEIGHT = 0.75, 0.25, 0.02
TIEBREAK_CHARS = 3
TIER1_MARGIN, TIER2_MARGIN, TIER2_CEILING, TIER2_WEIGHT = 0.20, 0.10, 0.75, 0.35


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that isn't broadcast.

    What a plan is estimated to hold comes from the size of compressed files,
    so rows that grow with the input would be sent to the driver and held by
    every executor.
    """
    return rows.hint("merge")


def source_rank(source: Column) -> Column:
    out = F.lit(0)
    for name, rank in SOURCES.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def dedupe(definitions: DataFrame) -> DataFrame:
    """MNG-01: the best row of each (acronym, label): doc_id, acronym, label, source, conf, spans, and the first seq of any.

    One aggregation: the best is the least of an ordered struct.
    """
    rows = definitions.withColumn("label", fx.tighten_label("definition")).withColumn("acronym", F.upper("acronym"))
    order = F.struct(-F.col("conf"), -source_rank(F.col("source")), "def_s", "def_e", "acr_s", "acr_e", "seq")
    value = F.struct("label", "source", "conf", "acr_s", "acr_e", "def_s", "def_e")
    grouped = rows.groupBy("doc_id", "acronym", F.lower("label").alias("_l")).agg(F.min_by(value, order).alias("v"), F.min("seq").alias("seq"))
    return grouped.select("doc_id", "acronym", "v.*", "seq")


def build(deduped: DataFrame) -> DataFrame:
    """MNG-02: meanings: doc_id, acronym, meaning_id, label, support, conf and the definitions' spans."""
    meaning = F.concat_ws("|", F.lower("acronym"), fx.slug("label", empty="x"))
    return (
        deduped.withColumn("meaning_id", meaning)
        .groupBy("doc_id", "acronym", "meaning_id")
        .agg(F.min_by("label", "seq").alias("label"), F.count("*").alias("support"), F.max("conf").alias("conf"), F.array_sort(F.collect_list(F.struct("def_s", "def_e"))).alias("spans"))
    )


def tier1_scores(occurrences: DataFrame, meanings: DataFrame) -> DataFrame:
    """MNG-03, MNG-04: every occurrence with every meaning of its acronym and the score.

    ``occurrences``: doc_id, acronym, s, e, near (words around).
    """
    m = meanings.select(F.col("doc_id").alias("_d"), F.col("acronym").alias("_a"), "meaning_id", "conf", "spans", fx.word_set("label").alias("words"))
    j = occurrences.join(shuffled(m), (occurrences["doc_id"] == m["_d"]) & (F.upper(occurrences["acronym"]) == m["_a"]))
    near = F.array_min(F.transform("spans", lambda x: F.abs(F.col("s") - F.floor((x["def_s"] + x["def_e"]) / 2))))
    overlap = F.when(F.size("words") > 0, F.size(F.array_intersect("words", "near")) / F.size("words")).otherwise(0.0)
    center = (F.col("s") + F.col("e")) / 2.0
    gap = F.array_min(F.transform("spans", lambda x: F.floor(F.abs((x["def_s"] + x["def_e"]) / 2.0 - center))))
    base = DISTANCE_WEIGHT / (1.0 + near) + OVERLAP_WEIGHT * overlap
    rows = j.select("doc_id", "acronym", "s", "e", "meaning_id", "conf", base.alias("base"), gap.alias("distance"))
    by = ["doc_id", "acronym", "s", "e"]
    two = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("base", "meaning_id", "conf", "distance")), asc=False).alias("c"))
    first, second = F.element_at("c", 1)["base"], F.try_element_at("c", F.lit(2))["base"]
    weight = F.when(second.isNull() | (first - second >= NEAR_TIE), 0.0).otherwise(PRIOR_WEIGHT * (1 - (first - second) / NEAR_TIE))
    spread = two.withColumn("w", weight).select(*by, "w", F.explode("c").alias("x"))
    return spread.select(*by, "x.meaning_id", "x.conf", "x.distance", (F.col("x.base") + F.col("w") * F.least(F.greatest("x.conf", F.lit(0.0)), F.lit(1.0))).alias("score"))


def choose(scored: DataFrame, margin: float = TIER1_MARGIN, always: bool = False) -> DataFrame:
    """MNG-06: by occurrence the chosen meaning or null, the relative margin and the gap. ``always``: the best, by whatever margin."""
    by = ["doc_id", "acronym", "s", "e"]
    rows = scored.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("score", "conf", "meaning_id", "distance")), asc=False).alias("c"))
    a, b = F.element_at("c", 1), F.try_element_at("c", F.lit(2))
    gap = a["score"] - F.coalesce(b["score"], F.lit(0.0))
    relative = gap / F.greatest(a["score"], F.lit(1e-9))
    nearer = F.when(a["distance"] - b["distance"] >= TIEBREAK_CHARS, b["meaning_id"]).when(b["distance"] - a["distance"] >= TIEBREAK_CHARS, a["meaning_id"])
    chosen = a["meaning_id"] if always else F.when(relative >= margin, a["meaning_id"]).when((F.size("c") > 1) & (gap <= NEAR_TIE), nearer)
    return rows.select(*by, F.size("c").alias("n_candidates"), chosen.alias("meaning_id"), relative.alias("margin"), gap.alias("gap"))


def disambiguate(occurrences: DataFrame, meanings: DataFrame, margin: float = TIER1_MARGIN) -> DataFrame:
    """MNG-07: every occurrence; an acronym without meanings stays without a choice."""
    chosen = choose(tier1_scores(occurrences, meanings), margin)
    return occurrences.select("doc_id", "acronym", "s", "e").join(shuffled(chosen), ["doc_id", "acronym", "s", "e"], "left").fillna(0.0, ["margin", "gap"]).fillna(0, ["n_candidates"])


def ambiguous(meanings: DataFrame) -> DataFrame:
    """MNG-08: by (doc_id, acronym) whether it has several meanings."""
    return meanings.groupBy("doc_id", "acronym").agg((F.countDistinct("meaning_id") > 1).alias("ambiguous"))


def select(decided: DataFrame, blended: DataFrame, mode: str = "auto", margin: float = TIER2_MARGIN) -> DataFrame:
    """MNG-08: the final choice of each occurrence, the tier it is of and whether it is undecided.

    ``decided``: of ``choose`` or ``disambiguate``. ``blended``: the rows of
    ``tier1_scores`` with blended scores, of those occurrences alone that tier 2
    was applied to; they are chosen among anew (mode ``on``: the best, whatever
    its margin). All others keep their first choice.
    """
    by = ["doc_id", "acronym", "s", "e"]
    again = choose(blended, margin, mode == "on").select(*by, F.struct("meaning_id", "margin", "gap").alias("_again"))
    rows = decided.join(shuffled(again), by, "left")
    new = F.col("_again").isNotNull()
    take = lambda name: F.when(new, F.col("_again")[name]).otherwise(F.col(name)).alias(name)
    out = rows.select(*by, "n_candidates", take("meaning_id"), take("margin"), take("gap"), F.when(new, 2).otherwise(1).alias("tier"))
    return out.withColumn("undecided", F.col("meaning_id").isNull())


def coverage(firsts: DataFrame, definitions: DataFrame) -> DataFrame:
    """EXT-15: by document the share of keys with a definition and the keys without."""
    known = definitions.select(F.col("doc_id").alias("_d"), F.upper("acronym").alias("_k")).distinct().withColumn("_y", F.lit(1))
    j = firsts.join(shuffled(known), (firsts["doc_id"] == known["_d"]) & (F.upper(firsts["key"]) == known["_k"]), "left")
    return j.groupBy("doc_id").agg(F.avg(F.coalesce("_y", F.lit(0))).alias("coverage"), F.array_sort(F.collect_list(F.when(F.col("_y").isNull(), F.col("key")))).alias("missing"))


# ---- tier 2 -----------------------------------------------------------------------


def route(decided: DataFrame, mode: str = "auto", only_undecided: bool = False, ceiling: float = TIER2_CEILING) -> DataFrame:
    """T2-01: why an occurrence is not reranked, null where it is. ``decided``: of ``choose``, with ``ambiguous``."""
    reason = F.when(F.col("n_candidates") < 2, "single_candidate").when(~F.col("ambiguous"), "not_ambiguous")
    if mode != "on" and only_undecided:
        reason = reason.when(F.col("meaning_id").isNotNull(), "tier1_decided")
    if mode == "auto":
        reason = reason.when(F.col("margin") >= ceiling, "tier1_confident")
    return decided.withColumn("reason", reason)


def route_terms(decided: DataFrame, mode: str = "auto", only_undecided: bool = False, ceiling: float = TIER2_CEILING) -> DataFrame:
    """TRM-15: the same for mentions of terms: none is left out for not being ambiguous, but one is if a meaning has no text.

    ``decided``: n_candidates, meaning_id, margin and ``complete`` (every candidate has a definition).
    """
    if mode == "off":
        return decided.withColumn("reason", F.lit("disabled"))
    reason = F.when(F.col("n_candidates") < 2, "single_candidate")
    if only_undecided:
        reason = reason.when(F.col("meaning_id").isNotNull(), "tier1_decided")
    if mode == "auto":
        reason = reason.when(F.col("margin") >= ceiling, "tier1_confident")
    return decided.withColumn("reason", reason.when(~F.coalesce("complete", F.lit(False)), "no_meanings"))


def candidate_texts(meanings: DataFrame, name: str = "acronym", text: str = "label") -> DataFrame:
    """T2-03: the distinct texts that a model embeds for meanings: what is meant, a colon, its definition. Blank ones have none."""
    return meanings.where(F.col(text) != "").select(F.concat_ws(": ", name, text).alias("text")).distinct()


def hashed_embedding(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """T2-04: a deterministic stand-in for an embedding model: signed hashes of words, of length one."""
    import re
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"[a-z0-9]+", text.lower()):
                h = zlib.crc32(word.encode())
                out[i, h % dims] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


def embed(rows: DataFrame, column: str, model: Callable[[list[str]], np.ndarray], output: str = "vector", batch: int = 64) -> DataFrame:
    """T2-04, RAG-02: adds vectors, ``batch`` distinct texts to a call, in Arrow batches."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])
    k = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(k).to_pylist()]
            order = list(dict.fromkeys(texts))
            vectors = {}
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                vectors |= dict(zip(part, np.asarray(model(part), np.float32).tolist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([vectors[t] for t in texts], pa.list_(pa.float32()))], names=[*b.schema.names, output])

    return rows.mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine01(a: Column, b: Column) -> Column:
    """T2-05."""
    n = norm(a) * norm(b)
    return F.least(F.greatest(0.5 * (F.when(n == 0, 0.0).otherwise(dot(a, b) / n) + 1.0), F.lit(0.0)), F.lit(1.0))


def normalise(a: Column) -> Column:
    """RAG-03: to length one; the zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: (x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)).cast("float"))


def blend(tier1: Column, similarity: Column, weight: float = TIER2_WEIGHT) -> Column:
    """T2-06; without a similarity (T2-07) tier 1 stands."""
    return F.when(similarity.isNull(), tier1).otherwise((1 - weight) * tier1 + weight * similarity)


def report(routed: DataFrame) -> DataFrame:
    """T2-08."""
    return routed.groupBy(F.coalesce("reason", F.lit("applied")).alias("reason")).agg(F.count("*").alias("n"))
