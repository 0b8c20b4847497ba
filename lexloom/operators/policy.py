"""Blocks of results and the choice among candidates (RES)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as fx

STRICT, FALLBACK_GENERAL, DOMAIN_PRIORITY = "strict", "fallback_general", "domain_priority"


def blocks(occurrences: DataFrame) -> DataFrame:
    """RES-01: by surface: its first place, the places in order and their number."""
    places = F.array_sort(F.collect_list(F.struct("s", "e", "conf")))
    rows = occurrences.groupBy("doc_id", "acronym").agg(places.alias("occurrences"))
    return rows.select("doc_id", "acronym", F.element_at("occurrences", 1)["s"].alias("first_s"), F.size("occurrences").alias("n"), "occurrences")


def block_definitions(picks: DataFrame, ledger: DataFrame, least: float = 0.0, most: int = 5) -> DataFrame:
    """RES-02: by (doc_id, acronym) at most ``most`` definitions: the pick first, then by confidence and text."""
    both = picks.withColumn("_pick", F.lit(0)).unionByName(ledger.withColumn("_pick", F.lit(1))).where(F.col("conf") >= least)
    one = both.groupBy("doc_id", "acronym", "definition", "s", "e").agg(F.min("_pick").alias("_pick"), F.max("conf").alias("conf"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "acronym").orderBy("_pick", F.desc("conf"), "definition", "s", "e"))
    return one.withColumn("nth", nth).where(F.col("nth") <= most).select("doc_id", "acronym", "nth", "definition", "s", "e", "conf")


def glossary_blocks(listed: DataFrame, lang: str = "en") -> DataFrame:
    """RES-03: by request the active, non-blank meanings by domain and definition without regard to case; none, no row.

    ``listed``: of ``glossary.list_meanings``, whose order decides between equals.
    """
    usable = listed.where(F.col("is_active") & F.col("definition").rlike("(?U)\\S"))
    item = F.struct(
        F.lower(F.coalesce("domain", F.lit(""))).alias("_d"), F.lower("definition").alias("_t"), "nth", "definition", "domain", F.lit(lang).alias("lang"), F.lit(1.0).alias("confidence"), F.lit("system").alias("source")
    )
    rows = usable.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("_m"))
    return rows.select("request_id", F.transform("_m", lambda x: x.dropFields("_d", "_t", "nth")).alias("matches"))


def candidates(document: DataFrame, glossary: DataFrame) -> DataFrame:
    """RES-03..05: by (doc_id, acronym) the document's candidates, then glossary ones that say something else.

    ``document``: doc_id, acronym, definition, s, e. ``glossary``: acronym,
    meaning_id, domain, definition, is_active; it is joined to the document's acronyms.
    """
    doc = document.where(F.btrim("definition") != "").select(
        "doc_id", "acronym", F.lit("document").alias("provenance"), F.lit(None).cast("string").alias("domain"), F.btrim("definition").alias("definition"), F.concat(F.lit("text_span:"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string")).alias("source_ref")
    )
    keys = document.select("doc_id", "acronym").distinct()
    active = keys.join(glossary.where("is_active").where(F.btrim("definition") != ""), "acronym").select(
        "doc_id", "acronym", F.lit("glossary").alias("provenance"), "domain", F.btrim("definition").alias("definition"), F.concat(F.lit("meaning:"), F.col("meaning_id").cast("string")).alias("source_ref")
    )
    said = doc.select(F.col("doc_id").alias("_d"), F.col("acronym").alias("_a"), fx.policy_definition("definition").alias("_n")).distinct()
    other = active.join(said, (active["doc_id"] == said["_d"]) & (active["acronym"] == said["_a"]) & (fx.policy_definition(active["definition"]) == said["_n"]), "left_anti")
    return doc.unionByName(other)


def inactive(document: DataFrame, glossary: DataFrame) -> DataFrame:
    """RES-05: inactive glossary meanings by (doc_id, acronym)."""
    keys = document.select("doc_id", "acronym").distinct()
    return keys.join(glossary, "acronym").groupBy("doc_id", "acronym").agg(F.count_if(~F.col("is_active")).alias("n_inactive"))


def select(candidates: DataFrame, inactive: DataFrame, mode: str = STRICT, most: int = 5) -> DataFrame:
    """RES-06..08: by (doc_id, acronym) the choice with its reason, the conflict and the ordered candidates."""
    order = F.struct(
        (F.col("provenance") != "document").alias("later"),
        F.lower("definition").alias("d"),
        F.lower(F.coalesce("domain", F.lit(""))).alias("m"),
        F.coalesce("source_ref", F.lit("")).alias("r"),
        "definition",
        "domain",
        "provenance",
        "source_ref",
    )
    rows = candidates.groupBy("doc_id", "acronym").agg(F.array_sort(F.collect_list(order)).alias("c")).join(inactive, ["doc_id", "acronym"], "left").fillna(0, ["n_inactive"])
    first = F.element_at("c", 1)
    from_glossary = F.filter("c", lambda x: x["later"])
    general = F.try_element_at(F.filter("c", lambda x: x["m"] == "general"), F.lit(1))
    own = ~first["later"]
    alone = (F.size("c") == F.size(from_glossary)) & (F.size("c") == 1)
    single = F.when(F.col("n_inactive") > 0, "inactive_filtered").otherwise("single_candidate")
    reason = F.when(own, "in_document_definition")
    choice = F.when(own, first)
    if mode == STRICT:
        reason, choice = reason.when(alone, single), choice.when(alone, first)
    else:
        if mode == DOMAIN_PRIORITY:
            reason, choice = reason.when(alone, single), choice.when(alone, first)
        reason = reason.when(general.isNotNull(), "fallback_general").otherwise("highest_score")
        choice = choice.when(general.isNotNull(), general).otherwise(first)
    rows = rows.withColumn("x", choice).withColumn("reason", reason)
    ordered = F.concat(F.filter(F.array("x"), lambda x: x.isNotNull()), F.filter("c", lambda x: F.col("x").isNull() | ~x.eqNullSafe(F.col("x"))))
    ref = F.transform(F.slice(ordered, 1, most), lambda x: F.coalesce(x["source_ref"], F.lit("")))
    return rows.select("doc_id", "acronym", F.col("x.definition").alias("definition"), F.col("x.domain").alias("domain"), "reason", (F.size("c") > 1).alias("conflict"), F.size("c").alias("conflict_count"), F.col("n_inactive").cast("long").alias("n_inactive"), F.array_join(ref, ",").alias("candidates"))


def term_blocks(resolutions: DataFrame) -> DataFrame:
    """RES-09: by document its resolved mentions as an ordered array."""
    item = F.struct("s", "e", "term", "key", "meaning_id", F.col("meaning_id").isNotNull().alias("resolved"))
    return resolutions.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("defined_terms"))


def structure_blocks(links: DataFrame) -> DataFrame:
    """RES-09: by document its references as an ordered array."""
    item = F.struct("s", "e", "canonical_key", "kind", "label", "target_s", "target_e", "match_strategy", "strength", (F.col("strength") > 0).alias("resolved"))
    return links.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("structural_references"))


def response(**sections: DataFrame) -> DataFrame:
    """RES-10: the sections of each document side by side, and as JSON; a section that didn't run has no column."""
    out = None
    for rows in sections.values():
        out = rows if out is None else out.join(rows, "doc_id", "full_outer")
    names = [c for c in out.columns if c != "doc_id"]
    return out.withColumn("json", F.to_json(F.struct(*names)))


def ui_rows(blocks: DataFrame) -> DataFrame:
    """RES-11: the primary definition: the first extracted, else the first of the glossary."""
    return blocks.withColumn("primary", F.coalesce(F.try_element_at("definitions", F.lit(1)), F.try_element_at("glossary", F.lit(1))))
