"""The glossary (GLO): lookups over acronyms, meanings and variants, and its upkeep.

Tables: acronyms(id, acronym, normalized, is_active), meanings(id, acronym_id,
definition, domain, provenance, source_ref, is_active, created_at) and
variants(acronym_id, variant). Lookups are for a table of requests at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GENERAL = "general"
MOST_ACRONYMS = 50


def _normal(c):
    return F.lower(F.btrim(c))


def definitions(requests: DataFrame, acronyms: DataFrame, meanings: DataFrame, limit: int = 5) -> DataFrame:
    """GLO-01: for (request_id, acronym, domain) the active definitions, newest first."""
    a = acronyms.where("is_active").select(F.col("id").alias("_a"), "normalized")
    m = meanings.where("is_active").select("acronym_id", "id", "definition", F.lower("domain").alias("_domain"), "created_at")
    r = requests.select("request_id", _normal("acronym").alias("_n"), F.lower(F.coalesce("domain", F.lit(GENERAL))).alias("_d"))
    j = r.join(a, r["_n"] == a["normalized"]).join(m, (F.col("_a") == m["acronym_id"]) & (F.col("_d") == m["_domain"]))
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("created_at"), F.desc("id")))
    return j.withColumn("nth", nth).where(F.col("nth") <= limit).select("request_id", "nth", F.col("id").alias("meaning_id"), "definition")


def by_alias(requests: DataFrame, acronyms: DataFrame, meanings: DataFrame, variants: DataFrame, limit: int = 5) -> DataFrame:
    """GLO-02: the same by a variant's spelling; without a domain only general ones."""
    v = variants.select(F.lower("variant").alias("_v"), F.col("acronym_id").alias("_a"))
    named = requests.join(v, _normal(requests["acronym"]) == v["_v"]).join(acronyms.select(F.col("id").alias("_i"), "normalized"), F.col("_a") == F.col("_i"))
    return definitions(named.select("request_id", F.col("normalized").alias("acronym"), "domain"), acronyms, meanings, limit)


def list_acronyms(acronyms: DataFrame, meanings: DataFrame, prefix: str = "", domain: str | None = None, limit: int = MOST_ACRONYMS) -> DataFrame:
    """GLO-03: the first acronyms with a prefix that have an active meaning in the domain (general unless named)."""
    m = meanings.where("is_active").where(F.lower("domain") == (domain or GENERAL).lower()).select(F.col("acronym_id").alias("_a"))
    a = acronyms.where("is_active").where(F.lower("acronym").startswith(prefix.lower()))
    return a.join(m, a["id"] == m["_a"], "left_semi").select("acronym").distinct().orderBy("acronym").limit(limit)


def upsert(meanings: DataFrame, changes: DataFrame) -> DataFrame:
    """GLO-04: new entries by (acronym_id, domain); of known ones provenance, source_ref and is_active change, not the definition.

    Plain files have no MERGE, so the result is the whole table to be written
    elsewhere. ``changes``: acronym_id, domain, definition, provenance, source_ref, is_active.
    """
    c = changes.select(F.col("acronym_id").alias("_a"), F.col("domain").alias("_d"), F.struct("definition", "provenance", "source_ref", "is_active").alias("c"))
    j = meanings.join(c, (meanings["acronym_id"] == c["_a"]) & (meanings["domain"] == c["_d"]), "full_outer")
    known = F.col("acronym_id").isNotNull()
    new = F.col("c").isNotNull()
    take = lambda name: F.when(new, F.col(f"c.{name}")).otherwise(F.col(name)).alias(name)
    return j.select(
        F.coalesce("acronym_id", "_a").alias("acronym_id"),
        F.coalesce("domain", "_d").alias("domain"),
        F.when(known, F.col("definition")).otherwise(F.col("c.definition")).alias("definition"),
        take("provenance"),
        take("source_ref"),
        take("is_active"),
    )


def deactivate(meanings: DataFrame, ids: DataFrame, at) -> DataFrame:
    """GLO-04: all meanings; the active ones among ``ids`` (meaning_id) become inactive and take ``at`` as updated_at.

    Unknown ids and meanings that are inactive already change nothing; an id
    that isn't positive is an error of the query.
    """
    wrong = F.raise_error(F.lit("a meaning's id must be positive")).cast("long")
    gone = ids.select(F.when(F.col("meaning_id") > 0, F.col("meaning_id").cast("long")).otherwise(wrong).alias("_gone")).distinct()
    before = F.col("updated_at") if "updated_at" in meanings.columns else F.lit(None).cast("timestamp")
    hit = F.col("_gone").isNotNull() & F.col("is_active")
    kept = [c for c in meanings.columns if c not in ("is_active", "updated_at")]
    j = meanings.join(gone, meanings["id"] == gone["_gone"], "left")
    return j.select(*kept, (F.col("is_active") & ~hit).alias("is_active"), F.when(hit, F.lit(at).cast("timestamp")).otherwise(before).alias("updated_at"))


def list_meanings(requests: DataFrame, acronyms: DataFrame, meanings: DataFrame, variants: DataFrame) -> DataFrame:
    """GLO-05: all meanings of an acronym, found by its name or else by a variant; numbered: active first, domain, definition, id."""
    r = requests.select("request_id", _normal("acronym").alias("_n"))
    a = acronyms.select(F.col("id").alias("_by_name"), "normalized")
    v = variants.select(F.lower("variant").alias("_v"), F.col("acronym_id").alias("_by_variant")).groupBy("_v").agg(F.min("_by_variant").alias("_by_variant"))
    found = r.join(a, r["_n"] == a["normalized"], "left").join(v, F.col("_n") == F.col("_v"), "left").select("request_id", F.coalesce("_by_name", "_by_variant").alias("_a")).where("_a is not null")
    m = meanings.where(F.btrim("definition") != "")
    j = found.join(m, found["_a"] == m["acronym_id"])
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("is_active"), "domain", "definition", "id"))
    return j.select("request_id", nth.alias("nth"), F.col("id").alias("meaning_id"), "domain", "definition", "is_active")


def get(requests: DataFrame, acronyms: DataFrame, meanings: DataFrame) -> DataFrame:
    """GLO-06: the definition in the domain asked for, else the general one."""
    asked = definitions(requests, acronyms, meanings, 1).withColumn("_p", F.lit(0))
    general = definitions(requests.withColumn("domain", F.lit(GENERAL)), acronyms, meanings, 1).withColumn("_p", F.lit(1))
    return asked.unionByName(general).groupBy("request_id").agg(F.min_by(F.struct("meaning_id", "definition", (F.col("_p") == 1).alias("fell_back")), "_p").alias("v")).select("request_id", "v.*")
