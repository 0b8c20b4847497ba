"""Contract texts made from relational tables, by SQL that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.session import spread

#: One contract for each customer. Only ASCII, so that both engines' patterns agree.
CONTRACTS_SQL = """
SELECT c_custkey AS doc_id, concat(
  'This Master Supply Agreement (the "Agreement") binds ', replace(c_name, '#', ' '), ' of ', n_name, '.', chr(10), chr(10),
  '1 Definitions', chr(10),
  '"Services" means the delivery of class ', c_custkey % 7, ' goods. ',
  'The Regional Supply Board (RSB) supervises delivery and the RSB publishes rates. ',
  CASE c_custkey % 4 WHEN 0 THEN 'EMA (European Medicines Agency) and the EMA register apply. '
                     WHEN 1 THEN 'Every PO, short for Purchase Order, names a PO number. '
                     WHEN 2 THEN 'The Joint Audit Office [JAO] reports; the JAO meets. '
                     ELSE 'NGO stands for Non Governmental Organisation here. ' END,
  '"Delivery Date" shall mean the day of receipt under Annex ', chr(65 + CAST(c_custkey % 3 AS INT)), '; time counts.', chr(10),
  'Fees follow Section ', 2 + c_custkey % 3, '.1 and Schedule ', chr(65 + CAST(c_custkey % 4 AS INT)), ' (the "Fee Table").', chr(10), chr(10),
  '2.1 Fees', chr(10),
  'The Services are invoiced monthly under Clause 9. OK, the CEO may act. VAT is due in EU and US trade at 5 PM today.', chr(10),
  CASE WHEN c_custkey % 5 = 0 THEN concat('ALL GOODS REMAIN PROPERTY', chr(10)) ELSE '' END,
  '3.1 Termination', chr(10),
  'See section 2.1. Article ', CASE c_custkey % 3 WHEN 0 THEN 'IV' WHEN 1 THEN 'IX' ELSE '4' END,
  ' applies to the Agreement on the Delivery Date. Appendix C.A is void; Appendix C.2 holds.', chr(10),
  'Article ', CASE c_custkey % 2 WHEN 0 THEN 'IV' ELSE 'IX' END, ': Law', chr(10),
  '"Services" means support after Schedule B too. The Agreements and the Fee Table bind ', c_mktsegment, ' trade.', chr(10),
  'Schedule ', chr(65 + CAST(c_custkey % 3 AS INT)), ': Charges', chr(10),
  'The RSB sets Services charges by Exhibit 1 and the R & D plan.', chr(10)) AS text
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: one contract for each customer."""
    customer, nation = tables(spark, sf_dir, "customer", "nation")
    return spark.sql(CONTRACTS_SQL.replace("FROM customer JOIN nation", "FROM {customer} JOIN {nation}"), customer=spread(customer), nation=nation)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
