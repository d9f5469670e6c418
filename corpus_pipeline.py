"""Raw documents to token digests: quality rules, exact and near duplicates, mixing, byte-level BPE.

Stages take null, repeated and empty values in any column, very long texts, empty
tables and columns of any names: each row is named by its place in the stored table
or checkpoint that the stage reads, decisions are made and applied by that place
alone, and all columns are returned as they came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm._shared import ROW, cut, pinned, table
from gridquarry.llm.bpe import encoded
from gridquarry.llm.grace import exact_duplicates
from gridquarry.llm.mixing import mixed
from gridquarry.llm.queries import MULTI_RANKS, PATTERN
from gridquarry.llm.rules import judged
from gridquarry.llm.simhash import near_duplicates

#: What an input's own column is called meanwhile if it has the row number's name.
OWN = "__row of the input"


def _by_row(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``decide`` makes of the numbered rows of ``docs``, with the columns of ``docs``."""
    out = decide(pinned(docs.withColumnRenamed(ROW, OWN)))
    return out.drop(ROW).withColumnRenamed(OWN, ROW).select(*(f"`{c}`" for c in docs.columns))


def _where(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], flag: str) -> DataFrame:
    """The rows of ``docs`` whose decision holds."""
    return _by_row(docs, lambda rows: rows.join(operator(rows).where(flag).select(ROW), ROW, "left_semi"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts among them."""
    return _where(docs, judged, "kept")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then that of the smallest id, then the first row."""
    return _where(docs, exact_duplicates, "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the least id, then the first row."""
    return _where(docs, near_duplicates, "stays")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those without words are not taken more often than the rest of their source."""

    def taken(rows: DataFrame) -> DataFrame:
        copies = mixed(rows).where("copies > 0").select(ROW, F.expr("sequence(1L, copies)").alias("__copies"))
        return rows.select(ROW, F.struct("*").alias("__docs")).join(copies, ROW).select("__docs", F.explode("__copies")).select("__docs.*")

    return _by_row(docs, taken)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests; null texts are empty."""
    return encoded(docs, MULTI_RANKS, PATTERN).drop(ROW)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("simhash near dedup", near_dedup), ("mixing", mix), ("byte-level bpe", tokens)]

#: Fingerprints, expectation-maximisation and BPE aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
