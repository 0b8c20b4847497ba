"""The corpus pipeline: five stages, each over all that the one before kept.

Defined results: documents whose text is null, has no letter or is in no
language that can be told go in the first stage; of rows that repeat a text, and
of near copies, one stays, whatever their ids; rows without a ``doc_id`` are
documents like any; a table without rows gives none; columns beyond those named
are carried along untouched to the last stage, whatever their names. Each
operator's docstring has the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontamination, langid, packing, pii, simhash
from lexloom.session import checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; the others go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No contaminated document, and no benchmark span in the others."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data generalised, disclosing terms removed."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("decontamination", decontaminated), ("pii", private), ("best_fit_packing", packed)]

#: Tokenizers, trained models and component closure aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written as Parquet in the shared folder and read again.

    A stage's folder is deleted once the next one's is written; the last stays, as the result is read from it.
    """
    shared = checkpoint_dir(spark).rstrip("/")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    jvm = spark.sparkContext._jvm
    run_id = jvm.java.util.UUID.randomUUID().toString()
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{shared}/pipeline-{run_id}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            path = jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
