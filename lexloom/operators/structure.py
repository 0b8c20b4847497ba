"""Structural references and their anchors (STR): "Section 4.2", "Schedule B: Charges"."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as fx
from lexloom.operators import spans

# Kinds and their label forms. Two kinds never overlap, as no
# label can be a kind's word, so one alternation finds what seven scans would.
REFERENCE = (
    r"(?i)\b(?:(?:Schedule|Exhibit|Annex)[ \t]+(?:[A-Z]|\d+)"
    r"|Appendix[ \t]+(?:[A-Z](?:\.\d+)*|\d+)"
    r"|(?:Section|Clause)[ \t]+\d+(?:\.\d+)*"
    r"|Article[ \t]+(?:[IVXLCDM]+|\d+))\b"
)
NAMED_HEADING = r"(?i)^(Schedule|Section|Clause|Article|Appendix|Annex|Exhibit)\s+([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*)\b(?:\s*[:.\-–]\s*(\S.*))?$"
NUMBERED_HEADING = r"^(\d+(?:\.\d+)*)\s+(\S.*)$"


def references(docs: DataFrame, convert_roman: bool = False) -> DataFrame:
    """STR-01..04: doc_id, kind, label, canonical_label, normalized_key, canonical_key, s, e."""
    found = spans.matches(docs, REFERENCE, after=2)
    kind = fx.structure_kind(F.regexp_extract("surface", r"^([A-Za-z]+)", 1))
    label = F.regexp_extract("surface", r"^[A-Za-z]+[ \t]+(.*)$", 1)
    rows = found.select("doc_id", kind.alias("kind"), label.alias("label"), "s", "e", "after")
    goes_on = (F.col("kind") == "Appendix") & F.col("label").rlike(r"^\p{L}+$") & F.col("after").rlike(r"^\.\p{Lu}")
    rows = rows.where(~goes_on)
    roman = (F.lit(convert_roman) & (F.col("kind") == "Article")) & fx.is_roman("label")
    canonical = F.when(roman, fx.roman_value("label").cast("string")).otherwise(F.col("label"))
    rows = rows.withColumn("canonical_label", canonical).withColumn("normalized_key", fx.structure_key("kind", "label"))
    return rows.select("doc_id", "kind", "label", "canonical_label", "normalized_key", F.when(roman, fx.structure_key("kind", "canonical_label")).otherwise(F.col("normalized_key")).alias("canonical_key"), "s", "e")


def anchors(docs: DataFrame, convert_roman: bool = False) -> DataFrame:
    """STR-05: heading lines: doc_id, kind, label, title, key, s, e, ordinal."""
    rows = spans.lines(docs)
    named = F.regexp_extract("line", NAMED_HEADING, 2) != ""
    numbered = F.regexp_extract("line", NUMBERED_HEADING, 1) != ""
    pick = lambda k: F.when(named, F.regexp_extract("line", NAMED_HEADING, k))
    rows = rows.where(named | numbered).select(
        "doc_id",
        F.coalesce(fx.structure_kind(pick(1)), F.lit("Section")).alias("kind"),
        F.coalesce(pick(2), F.regexp_extract("line", NUMBERED_HEADING, 1)).alias("label"),
        F.nullif(F.when(named, pick(3)).otherwise(F.regexp_extract("line", NUMBERED_HEADING, 2)), F.lit("")).alias("title"),
        "s",
        "e",
    )
    label = F.when(F.lit(convert_roman) & (F.col("kind") == "Article") & fx.is_roman("label"), fx.roman_value("label").cast("string")).otherwise(F.col("label"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("s")) - 1
    return rows.select("doc_id", "kind", "label", "title", F.concat_ws("_", F.lower("kind"), fx.slug(label)).alias("key"), "s", "e", ordinal.cast("int").alias("ordinal"))


def links(references: DataFrame, anchors: DataFrame) -> DataFrame:
    """STR-06, STR-07: each reference and its nearest anchor, ahead before behind before around it.

    An equi-join on (doc_id, key), then one aggregation: the best anchor is the
    least (tier, distance, ordinal), so nothing is sorted.
    """
    a = anchors.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("s").alias("as"), F.col("e").alias("ae"), "ordinal")
    joined = references.join(a, (references["doc_id"] == a["_d"]) & (references["canonical_key"] == a["_k"]), "left")
    tier = F.when(F.col("as") >= F.col("e"), 1).when(F.col("ae") <= F.col("s"), 2).when(F.col("as").isNotNull(), 3)
    distance = F.when(tier == 1, F.col("as") - F.col("e")).when(tier == 2, F.col("s") - F.col("ae")).otherwise(0)
    best = F.min(F.when(tier.isNotNull(), F.struct(tier.alias("tier"), distance.alias("d"), "ordinal", F.col("as").alias("s"), F.col("ae").alias("e"))))
    by = ["doc_id", "kind", "label", "canonical_label", "normalized_key", "canonical_key", "s", "e"]
    rows = joined.groupBy(*by).agg(best.alias("b"))
    names = F.when(F.col("b.tier") == 1, "forward").when(F.col("b.tier") == 2, "backward").when(F.col("b.tier") == 3, "overlap").otherwise("unresolved")
    strength = F.when(F.col("b.tier") == 1, 1.0).when(F.col("b.tier") == 2, 0.75).when(F.col("b.tier") == 3, 0.5).otherwise(0.0)
    return rows.select(*by, F.col("b.s").alias("target_s"), F.col("b.e").alias("target_e"), names.alias("match_strategy"), strength.alias("strength"))


def unique_links(links: DataFrame) -> DataFrame:
    """STR-08: the first link of each key, a resolved one before any that is not."""
    order = F.struct((F.col("strength") == 0).alias("open"), "s", "e", "normalized_key")
    value = F.struct("kind", "label", "canonical_label", "s", "e", "target_s", "target_e", "match_strategy", "strength")
    return links.groupBy("doc_id", "canonical_key").agg(F.min_by(value, order).alias("v")).select("doc_id", "canonical_key", "v.*")


def resolve(docs: DataFrame, convert_roman: bool = False) -> DataFrame:
    """STR-09: the links of all references of ``docs``."""
    return links(references(docs, convert_roman), anchors(docs, convert_roman))
