"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of ``documents``.

Null, empty and very long texts, null ids and sources, ties and repeated rows pass as the stages'
operators say: a null text counts as empty and is never toxic, a line or a near duplicate; of rows with equal
texts the one with the smallest id stays (wordless texts all stay). The mixture may draw a document
twice. Other columns of the input are left out. An empty table gives an empty result of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.llm import lines, mixing, neardup, packing, toxicity
from registra.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not call toxic; fitted on the labelled ones."""
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter(~F.col("is_toxic")).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates; n_chars follows the text.

    Copies of a document count once for a template, so they stay for the next stage.
    """
    out = lines.drop_boilerplate_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id; texts without words stay."""
    return neardup.keep_one(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture draws, once for each time they are drawn."""
    return mixing.mix_sources(docs, carry=("text", "lang", "n_chars")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixture and their places in training sequences."""
    out = packing.pack_documents(docs)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near-duplicates", one_of_each),
    ("mixing", mix),
    ("packing", pack),
]

#: Model fitting, signatures and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
