"""Registered queries of the problems P6 to P9."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import lookalike, mixing, nearest, tokens
from kinelake.llm.sql import SQL  # noqa: F401
from kinelake.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The nearest reading of each gripper state."""
    return nearest.nearest_readings(table(spark, d, "hand_states"), table(spark, d, "joint_readings"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's ids."""
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the mix."""
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1].withColumn("actual_share", F.round("actual_share", 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same."""
    return lookalike.same_look_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class of texts that look the same."""
    return lookalike.same_look_classes(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text."""
    return lookalike.consistent_texts(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_found, p7_ids, p8_mix, p8_shares, p9_found, p9_classes, p9_forms)}
