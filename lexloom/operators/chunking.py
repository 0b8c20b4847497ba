"""Chunks of texts and the merge of what was found in them (CHK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The service's threshold, chunk and overlap, and the retriever's.
THRESHOLD, SIZE, OVERLAP = 30_000, 20_000, 1_200
RAG_SIZE, RAG_OVERLAP = 1_000, 150


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, skip_blank: bool = False) -> DataFrame:
    """CHK-01, CHK-08: doc_id, ordinal, s, e, last, text. Chunks step by size - overlap until the end is reached.

    An empty text is one empty chunk, or none where blanks are skipped (their
    ordinals are still counted).
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a chunk needs a size above its overlap")
    step = size - overlap
    n = F.length("text")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    rows = docs.where("text is not null").select("doc_id", "text", n.alias("_n"), last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    rows = rows.select("doc_id", "ordinal", (F.col("ordinal") * step).alias("s"), F.least(F.col("ordinal") * step + size, F.col("_n")).alias("e"), (F.col("ordinal") == F.col("_last")).alias("last"), "text")
    rows = rows.withColumn("text", F.substring("text", F.col("s") + 1, F.col("e") - F.col("s")))
    return rows.where(F.btrim("text") != "") if skip_blank else rows


def needs_chunks(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """CHK-02."""
    return docs.withColumn("chunked", F.length("text") > threshold)


def shift(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """CHK-03: offsets in chunks become offsets in the document. ``found`` has doc_id, ordinal, s, e."""
    at = chunks.select(F.col("doc_id").alias("_d"), F.col("ordinal").alias("_o"), F.col("s").alias("_at"))
    j = found.join(at, (found["doc_id"] == at["_d"]) & (found["ordinal"] == at["_o"]))
    return j.withColumn("s", F.col("s") + F.col("_at")).withColumn("e", F.col("e") + F.col("_at")).drop("_d", "_o", "_at")


def merge_occurrences(shifted: DataFrame) -> DataFrame:
    """CHK-04: one row per (doc_id, acronym, place), the surest of those seen in several chunks."""
    return shifted.groupBy("doc_id", "acronym", "s", "e").agg(F.max("conf").alias("conf"))


def merge_meanings(shifted: DataFrame) -> DataFrame:
    """CHK-05: meanings without repeats, numbered anew by key."""
    columns = [c for c in shifted.columns if c not in ("ordinal", "meaning_id")]
    one = shifted.select(*columns).distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("s", "e", "term")) - 1
    return one.withColumn("ordinal", nth.cast("int")).withColumn("meaning_id", F.concat_ws("|", "term", "key", F.col("ordinal").cast("string")))


def merge_links(shifted: DataFrame) -> DataFrame:
    """CHK-06: by reference its strongest link, by place of the target in a tie."""
    best = F.min_by(F.struct("target_s", "target_e", "match_strategy", "strength"), F.struct(-F.col("strength"), F.coalesce("target_s", F.lit(2**31 - 1))))
    return shifted.groupBy("doc_id", "kind", "label", "canonical_key", "s", "e").agg(best.alias("v")).select("doc_id", "kind", "label", "canonical_key", "s", "e", "v.*")


def in_chunks(docs: DataFrame, operator, size: int = SIZE, overlap: int = OVERLAP, settled: bool = False) -> DataFrame:
    """CHK-07: an operator over the chunks of each text; its offsets shifted, repeats still in.

    With ``settled`` a find stays only where it is furthest from the chunk's
    edges: what two chunks share goes by its start to the one before up to the
    middle, to the one behind from there. Finds of up to half the overlap that
    hang on no more text around them then come as from the whole text, once
    each and never cut short.
    """
    pieces = chunk(docs, size, overlap)
    keyed = pieces.select(F.struct("doc_id", "ordinal", "last").alias("doc_id"), "text")
    found = operator(keyed)
    flat = found.select(F.col("doc_id.ordinal").alias("ordinal"), F.col("doc_id.last").alias("_last"), F.col("doc_id.doc_id").alias("doc_id"), *[c for c in found.columns if c != "doc_id"])
    if settled:
        half = overlap // 2
        flat = flat.where(((F.col("ordinal") == 0) | (F.col("s") >= half)) & (F.col("_last") | (F.col("s") < size - overlap + half)))
    return shift(flat.drop("_last"), pieces)
