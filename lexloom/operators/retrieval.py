"""Retrieval and grounded review (RAG)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import checkpoint_dir, ship

TOP_K = 5
#: Questions that are held in memory at once; more go in rounds of so many.
QUESTIONS_AT_ONCE = 10_000
#: Vectors of the index that a worker compares with them at once.
_VECTORS_AT_ONCE = 512
GROUNDING, DOCUMENT = "[DETERMINISTIC_GROUNDING]", "[DOCUMENT]"


def ground(docs: DataFrame, payloads: DataFrame) -> DataFrame:
    """RAG-01: the text with its results as JSON in front."""
    p = payloads.select(F.col("doc_id").alias("_d"), "payload")
    j = docs.join(p, docs["doc_id"] == p["_d"], "left")
    return j.select("doc_id", F.concat(F.lit(f"{GROUNDING}\n"), F.coalesce("payload", F.lit("{}")), F.lit(f"\n\n{DOCUMENT}\n"), "text").alias("text"))


def split_grounding(text: Column) -> tuple[Column, Column]:
    """RAG-06: the JSON object in front (null without one) and the rest."""
    has = text.startswith(f"{GROUNDING}\n") & text.contains(f"\n\n{DOCUMENT}\n")
    body = F.substring(text, len(GROUNDING) + 2, 2**31 - 1)
    payload = F.substring_index(body, f"\n\n{DOCUMENT}\n", 1)
    ok = has & payload.rlike(r"(?s)^\s*\{") & F.try_parse_json(payload).isNotNull()
    rest = F.substring(body, F.length(payload) + len(DOCUMENT) + 4, F.length(body))
    return F.when(ok, payload), F.when(has, rest).otherwise(text)


def top_k(questions: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """RAG-04, RAG-05: by question the k vectors with the greatest inner product; ties by id. Exact.

    ``questions``: q, vector. ``index``: id, vector. Questions go out in
    rounds of about ``QUESTIONS_AT_ONCE``; every partition of the index keeps
    its own k best, so k rows per partition and question are shuffled, not
    every product. With several rounds each one's result is checkpointed and
    its questions are let go before the next, so the driver and the workers
    hold one round at a time. No questions or an empty index give no rows.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    ship(index.sparkSession)
    sc = index.sparkSession.sparkContext
    rounds = max(1, -(-questions.count() // QUESTIONS_AT_ONCE))
    if rounds > 1:
        checkpoint_dir(index.sparkSession)
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    out = None
    for r in range(rounds):
        part = questions.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r).select("q", "vector").toArrow()
        names = part.column("q").to_pylist()
        shared = sc.broadcast((names, _matrix(part.column("vector").combine_chunks())))
        one = index.select("id", "vector").mapInArrow(_local_best(shared, k), "q long, id long, score double")
        one = one.withColumn("nth", nth).where(F.col("nth") <= k)
        if rounds > 1:
            one = one.checkpoint()
            shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By row the ids and scores of the k greatest scores, the lesser id first where they tie. ``ids``: ascending, of the columns."""
    k = min(k, scores.shape[1])
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(scores, at, axis=1).min(axis=1, keepdims=True)
    tied = (scores >= least).sum(axis=1) > k
    if tied.any():
        at[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :k]
    return ids[at], np.take_along_axis(scores, at, axis=1)


def _local_best(shared, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        ids, scores = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
        for batch in batches:
            for at in range(0, batch.num_rows if names else 0, _VECTORS_AT_ONCE):
                b = batch.slice(at, _VECTORS_AT_ONCE)
                order = np.argsort(b.column(0).to_numpy(), kind="stable")
                more, more_scores = _best(b.column(0).to_numpy()[order], np.round(matrix @ _matrix(b.column(1))[order].T, 9), k)
                ids, scores = np.concatenate([ids, more], axis=1), np.concatenate([scores, more_scores], axis=1)
                first = np.lexsort((ids, -scores), axis=1)[:, :k]
                ids, scores = np.take_along_axis(ids, first, axis=1), np.take_along_axis(scores, first, axis=1)
        if ids.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ids.shape[1]), pa.int64()), pa.array(ids.ravel(), pa.int64()), pa.array(scores.ravel(), pa.float64())], names=["q", "id", "score"])

    return run


_MARKERS = ('"acronyms"', '"defined_terms"', '"structural_references"', '"normalized_key"', '"candidates"', '"selected"', '"definitions"')


def is_grounding_fragment(text: Column) -> Column:
    """RAG-08: two marks of the JSON or more, and neither block's header."""
    marks = sum((F.when(text.contains(m), 1).otherwise(0) for m in _MARKERS), F.lit(0))
    return (marks >= 2) & ~text.contains(GROUNDING) & ~text.contains(DOCUMENT)


def compact(retrieved: DataFrame) -> DataFrame:
    """RAG-07: at most one grounding and one excerpt of each document: question, doc_id, part, chunk.

    ``retrieved``: q, doc_id, chunk, s, e, score, grounding.
    """
    order = F.when(F.col("grounding"), F.struct((F.col("s") == 0).alias("a"), F.col("score").alias("b"), (F.col("e") - F.col("s")).alias("c"), (-F.col("chunk")).alias("d"))).otherwise(
        F.struct(F.lit(False).alias("a"), F.col("score").alias("b"), (F.col("e") - F.col("s")).alias("c"), (-F.col("chunk")).alias("d"))
    )
    part = F.when(F.col("grounding"), "grounding").otherwise("excerpt")
    return retrieved.groupBy("q", "doc_id", part.alias("part")).agg(F.max_by("chunk", order).alias("chunk"))


_SECTIONS = ("acronyms", "defined_terms", "structural_references")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _string(value: Column, path: str) -> Column:
    """A field that is a string, else null."""
    return F.when(_is(_get(value, path), "STRING"), _get(value, path, "string"))


def _items(payload: Column, section: str) -> Column:
    """A section's entries; none if it is no list."""
    there = _get(payload, section)
    return F.when(_is(there, "ARRAY"), _get(payload, section, "array<variant>")).otherwise(F.array().cast("array<variant>"))


def _unresolved(item: Column) -> Column:
    chosen = _get(item, "selected")
    blank = ~F.coalesce(_string(item, "selected.definition").rlike("(?U)\\S"), F.lit(False))
    by_choice = F.coalesce(_string(item, "selected.reason") == "unresolved", F.lit(False)) | blank
    no = F.coalesce(_string(item, "resolution_method") == "unresolved", F.lit(False)) | (_is(_get(item, "resolved"), "BOOLEAN") & ~F.coalesce(_get(item, "resolved", "boolean"), F.lit(True)))
    return _is(item, "OBJECT") & F.when(_is(chosen, "OBJECT"), by_choice).otherwise(no)


def _entry_summaries(items: Column, fields: Callable[[Column], list[Column]]) -> Column:
    """The objects among the entries, each as the fields that a reviewer reads."""
    return F.transform(F.filter(items, lambda x: _is(x, "OBJECT")), lambda x: F.struct(*fields(x)))


def _object(value: Column, path: str) -> Column:
    """A field that is an object, else null."""
    return F.when(_is(_get(value, path), "OBJECT"), _get(value, path))


def _first_string(item: Column, section: str, path: str) -> Column:
    return F.when(_is(_get(item, section), "ARRAY"), _string(item, f"{section}[0].{path}"))


def summaries(payloads: DataFrame) -> DataFrame:
    """RAG-09: by payload (id, payload as JSON) its three sections as a reviewer reads them, as JSON; entries that are no objects go.

    A definition is the selected one, else the first of the entry's own; a field
    that isn't of its kind is null. What is no JSON has empty sections.
    """
    rows = payloads.select("id", F.try_parse_json("payload").alias("_v"))
    rows = rows.select("id", *[_items(F.col("_v"), k).alias(k) for k in _SECTIONS])
    raw = lambda x, *names: [_get(x, n).alias(n) for n in names]
    fields = {
        "acronyms": lambda x: [
            *raw(x, "acronym"),
            F.coalesce(_string(x, "selected.definition"), _first_string(x, "definitions", "text")).alias("selected_definition"),
            _string(x, "selected.reason").alias("selection_reason"),
            *raw(x, "conflict"),
            _first_string(x, "candidates", "source_ref").alias("source_ref"),
        ],
        "defined_terms": lambda x: [*raw(x, "surface", "normalized_key"), _string(x, "chosen_definition_span.text").alias("chosen_definition_text"), *raw(x, "resolution_method", "resolved")],
        "structural_references": lambda x: [*[_object(x, n).alias(n) for n in ("reference_span", "target_span")], *raw(x, "match_strategy", "resolved")],
    }
    return rows.select("id", *[F.to_json(_entry_summaries(F.col(k), f), {"ignoreNullFields": "false"}).alias(k) for k, f in fields.items()])


def ambiguity(payloads: DataFrame) -> DataFrame:
    """RAG-09: by payload (id, payload as JSON) how many entries each section has and how many of them are unresolved; 0 for what is no list."""
    rows = payloads.select("id", F.try_parse_json("payload").alias("_v"))
    rows = rows.select("id", *[_items(F.col("_v"), k).alias(k) for k in _SECTIONS])
    counts = [F.size(k).alias(f"{k.removesuffix('s')}_count") for k in _SECTIONS]
    return rows.select("id", *counts, *[F.size(F.filter(k, _unresolved)).alias(f"unresolved_{k}") for k in _SECTIONS])


ACTIONS, OUTCOMES = ("proceed", "retry_once", "abstain"), ("answer", "answer_with_warning", "abstain")


def review(replies: DataFrame) -> DataFrame:
    """RAG-10, RAG-11: a reviewer's JSON, checked in order; what fails retries once if a pass is left, else abstains.

    ``replies``: id, raw, has_second_pass.
    """
    v = F.try_parse_json("raw")
    field = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    is_kind = lambda name, kind: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == kind, F.lit(False))
    rows = replies.select(
        "id",
        "has_second_pass",
        v.isNotNull().alias("json"),
        F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("object"),
        F.when(is_kind("action", "STRING"), field("action", "string")).alias("action"),
        F.when(is_kind("outcome", "STRING"), field("outcome", "string")).alias("outcome"),
        F.when(is_kind("answer_text", "STRING"), field("answer_text", "string")).alias("answer_text"),
        (~is_kind("answer_text", "VOID") & F.try_variant_get(v, "$.answer_text", "variant").isNotNull()).alias("has_answer"),
        (is_kind("sufficient_evidence", "BOOLEAN") & is_kind("ambiguity_detected", "BOOLEAN")).alias("flags"),
        is_kind("requested_second_pass", "BOOLEAN").alias("asked"),
    )
    fault = (
        F.when(~F.col("json"), "malformed_json")
        .when(~F.col("object"), "not_an_object")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS) & F.col("outcome").isin(*OUTCOMES), F.lit(False)), "unsupported_action_or_outcome")
        .when(~F.col("flags"), "missing_booleans")
        .when(~F.col("asked"), "missing_requested_second_pass")
        .when((F.col("action") == "retry_once") & ~F.col("has_second_pass"), "retry_without_a_pass")
        .when((F.col("action") == "abstain") & (F.col("outcome") != "abstain"), "inconsistent_abstain")
        .when((F.col("action") == "abstain") & F.col("has_answer"), "answer_while_abstaining")
        .when((F.col("action") != "abstain") & (F.col("outcome") == "abstain"), "inconsistent_proceed")
        .when((F.col("action") != "abstain") & (F.coalesce(F.btrim("answer_text"), F.lit("")) == ""), "missing_answer_text")
    )
    rows = rows.withColumn("fault", fault)
    bad = F.col("fault").isNotNull()
    retry = F.col("has_second_pass")
    return rows.select(
        "id",
        F.coalesce("fault", F.lit("")).alias("fault"),
        F.when(bad & retry, "retry_once").when(bad, "abstain").otherwise(F.col("action")).alias("action"),
        F.when(bad & retry, "answer_with_warning").when(bad, "abstain").otherwise(F.col("outcome")).alias("outcome"),
    )


def binding_conflicts(bindings: DataFrame) -> DataFrame:
    """RAG-12: keys that documents of one question define differently. ``bindings``: q, doc_id, key, definition."""
    rows = bindings.where(F.btrim("definition") != "")
    return rows.groupBy("q", "key").agg(F.count_distinct(F.btrim("definition")).alias("n")).where("n > 1")


def guard(assessments: DataFrame, conflicts: DataFrame) -> DataFrame:
    """RAG-12: an answer over conflicting bindings gets a warning."""
    c = conflicts.groupBy(F.col("q").alias("_q")).agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("keys"))
    j = assessments.join(c, assessments["id"] == c["_q"], "left")
    hit = F.col("keys").isNotNull() & (F.col("action") != "abstain")
    return j.select("id", "action", F.when(hit & (F.col("outcome") == "answer"), "answer_with_warning").otherwise(F.col("outcome")).alias("outcome"), F.when(hit, F.col("keys")).otherwise("").alias("conflicts"))


def answer(ask: Callable[[int], DataFrame], judge: Callable[[DataFrame, bool], str], k: int = TOP_K) -> tuple[DataFrame, str]:
    """RAG-13: retrieve, review, and once more with max(2k, k + 1) if the review asks for it."""
    evidence = ask(k)
    action = judge(evidence, True)
    if action == "retry_once":
        evidence = ask(max(2 * k, k + 1))
        action = judge(evidence, False)
    return evidence, action
