"""Proportional stratified interleaving of documents into shards, in DataFrame operations only.

The rows of each source are shuffled by a seeded hash of ``doc_id`` and
ranked; a row's fractional rank is (rank - 1/2) / rows of its source. All rows
are put in order of fractional rank and cut into equal runs, so every shard
holds every source in its share of the whole.

Neither ranking gathers a source or the table in one task: rows are ranked in
``BUCKETS`` ranges of the order, and the ranges' counts (one small row each)
are summed up to offsets. The hash spreads a hot source evenly over its
ranges; fractional ranks are evenly spread by construction.

Defined results: a null text has size 1 and CRC 0; null is a source of its
own; rows that repeat a ``doc_id`` are placed each on its own, next to each
other within their source; ties of fractional rank go by source; a table with
fewer rows than shards leaves shards empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
SEED = "lexloom"
#: Ranges of either order; a power of 16.
BUCKETS = 4096


def _hash(seed: str) -> Column:
    """60 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _offsets(counted: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Rows in earlier ranges and in all, for each range."""
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard and source."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))).withColumn("_hash", _hash(seed))
    rows = rows.withColumn("_range", F.shiftrightunsigned("_hash", 48).cast("int"))
    counts = _offsets(rows.groupBy("_source", "_range").agg(F.count("*").alias("_n")), ["_source"], "_range")
    counts = counts.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), "_before", "_all")
    nth = F.row_number().over(Window.partitionBy("_source", "_range").orderBy("_hash", "doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("_nth", nth).join(counts, (F.col("_source") == F.col("_s")) & (F.col("_range") == F.col("_r")))
    fraction = (2 * (F.col("_before") + F.col("_nth")) - 1) / (2 * F.col("_all")).cast("double")
    ranked = ranked.withColumn("_fraction", fraction).select("doc_id", "source", "size", "text_crc32", "_source", "_fraction")
    ranked = ranked.withColumn("_range", F.floor(F.col("_fraction") * BUCKETS).cast("int"))
    counts = _offsets(ranked.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1)), ["_one"], "_range")
    counts = counts.select(F.col("_range").alias("_r"), "_before", "_all")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("_fraction", "_source", "doc_id", "text_crc32", "size"))
    placed = ranked.withColumn("_nth", nth).join(counts, F.col("_range") == F.col("_r"))
    place = (F.col("_before") + F.col("_nth") - 1).cast("long")
    placed = placed.withColumn("_place", place).withColumn("shard", F.expr(f"CAST(_place * {shards} DIV _all AS INT)"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"_place - (shard * _all + {shards - 1}) DIV {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
