"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, ctw, link_trust, mixing, neighbours, packing, sharding, simhash, token_output, weak_rules, whitening, windows
from .common import read_table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(read_table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(read_table(spark, sf_dir, "documents"), with_ids=False)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(read_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.perspectives(read_table(spark, sf_dir, "conversations"))
    return turns.withColumn("segment_md5", F.md5("segment")).drop("segment")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), preference=mixing.preferred())


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"))


def op13_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_url_filters, op2_simhash, op3_token_output, op4_lm_scoring, op5_quality_rules, op6_sharding, op7_chat_formatting, op8_mixing,
        op9_neighbours, op10_packing, op11_whitening, op12_alignment, op13_windows,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_formatting": chat.ORACLE, "op8_mixing": mixing.ORACLE, "op9_neighbours": neighbours.ORACLE}
