"""One query per operator of this subpackage over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontamination, gif_media, langid, packing, pii, quality, sharding, simhash, substring_dedup, toxicity
from lexloom.session import spread


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out if they lie in fewer partitions than there are cores."""
    return spread(_read(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_documents(spark, sf_dir), _read(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_documents(spark, sf_dir), texts=False)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_documents(spark, sf_dir), _read(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_documents(spark, sf_dir), _read(spark, sf_dir, "benchmark"))


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.stored_texts(_documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


_SUBSTRING_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM docs WHERE len(ws) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM later, (SELECT unnest(range(20)) AS k)
), words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM docs
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.pos) AS text, count(*) AS n
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos WHERE g.pos IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_DECONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), sized AS (
  SELECT item, ws, least(len(ws), 13) AS n FROM items WHERE len(ws) > 0
), item_windows AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)
), sizes AS (
  SELECT DISTINCT n FROM sized
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, sizes WHERE len(ws) >= n)
), hits AS (
  SELECT d.doc_id, d.i, d.n, w.item FROM doc_windows d JOIN item_windows w ON d.n = w.n AND d.win = w.win
), hit_words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(found, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM docs d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
"""


#: CRC-32 by a table from its rule, over blocks of 512 bytes from the end; earlier blocks are shifted by the linear map of 512 zero bytes.
_CRC_SQL = r"""
steps AS (
  SELECT n::BIGINT AS n, n::BIGINT AS c, 0 AS k FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT string_agg(printf('%08x', c), '' ORDER BY n) AS t FROM steps WHERE k = 8
), hexed AS (SELECT row_number() OVER () AS r, doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT r, j, list_transform(range(a, b), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM (
    SELECT r, h, j, greatest(length(h) // 2 - 512 * (m - j), 0) AS a, length(h) // 2 - 512 * (m - j - 1) AS b
    FROM (SELECT r, h, (length(h) // 2 + 511) // 512 AS m, unnest(range(0, (length(h) // 2 + 511) // 512)) AS j FROM hexed))
), raw AS (SELECT r, list(list_reduce(bytes, lambda c, x: xor(c >> 8, ('0x' || substr(t, 8 * (xor(c, x) & 255) + 1, 8))::BIGINT), CASE WHEN j = 0 THEN 4294967295 ELSE 0 END) ORDER BY j) AS parts FROM blocks, crc_table GROUP BY r
), shifts AS (SELECT list(v ORDER BY b) AS cs FROM (SELECT b, list_reduce(list_transform(range(512), lambda i: 0::BIGINT), lambda c, x: xor(c >> 8, ('0x' || substr(t, 8 * (xor(c, x) & 255) + 1, 8))::BIGINT), (1::BIGINT << b)) AS v FROM range(32) q(b), crc_table)
), crcs AS (
  SELECT r, xor(list_reduce(parts, lambda c, p: xor(p, list_reduce(range(32), lambda s, b: xor(s, CASE WHEN (c >> b) & 1 = 1 THEN cs[b + 1] ELSE 0 END), 0::BIGINT))), 4294967295) AS crc FROM raw, shifts
)"""

_SHARDING_SQL = f"""
WITH RECURSIVE {_CRC_SQL}, rows AS (
  SELECT doc_id, source, (length(h) // 2 + 1)::BIGINT AS size, coalesce(crc, 0)::BIGINT AS text_crc32, coalesce('+' || source, '-') AS s,
         ('0x' || substr(md5('{sharding.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM hexed LEFT JOIN crcs ON hexed.r = crcs.r
), ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY s ORDER BY hash, doc_id, text_crc32, size) - 1) / (2 * count(*) OVER (PARTITION BY s))::DOUBLE AS fraction FROM rows
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, s, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 16 // n)::INT AS shard, (place - ((place * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM placed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_pii, op3_language_id, op4_substring_dedup, op5_quality, op6_decontamination, op7_gif_media, op8_simhash, op9_sharding, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": _SUBSTRING_SQL, "op6_decontamination": _DECONTAMINATION_SQL, "op9_sharding": _SHARDING_SQL}
