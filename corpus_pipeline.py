"""From raw documents to packed training sequences, in four stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; it works on all its predecessor kept, and all but the
last return the columns of documents. `run` writes every stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalends.llm import mixing, near_text, packing, weak_rules
from kalends.llm.common import drop_rows, on_workers, read_table, stage, with_rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go; rows are judged one by one, also those that repeat a doc_id or lack one.

    Null and empty texts are rejected; an empty table gives an empty result; columns keep their names and values.
    """
    on_workers(spark)
    rows, row = with_rows(docs)
    verdicts = weak_rules.judge(rows.select(F.col(row).alias("doc_id"), "text"))
    return drop_rows(rows, verdicts.where("NOT kept").select(F.col("doc_id").alias(row)), row).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the least doc_id (nulls last); repeated rows are copies.

    An empty table gives an empty result; columns keep their names and values.
    """
    on_workers(spark)
    return near_text.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row comes as often as the mix takes it, not at all for most of an abundant source's.

    Rows that repeat a doc_id or lack one are drawn one by one, so a source's target holds for them too; rows without
    words aren't taken. An empty table gives an empty result; columns keep their names and values.
    """
    on_workers(spark)
    rows, row = with_rows(docs)
    mixed = mixing.mix(rows.select("doc_id", "source", "text", F.col(row).alias("key")), carry=("key",))
    copies = mixed.where("copies > 0").select(F.col("key").alias(row), F.col("copies").cast("int").alias("times"))
    copies = copies.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).select(row)
    return rows.join(copies, row).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences. Null texts are the end id alone; rows count as often as they come."""
    on_workers(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Tokens and set similarities have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
