"""Queries p6 to p8 over the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.mixing import Mixture
from tallyforge.llm.packing import fill_report, pack
from tallyforge.llm.toxicity import THRESHOLD, rates, score
from tallyforge.session import table


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document (piece) with its container of 2,048 tokens."""
    return pack(table(spark, d, "documents").select("doc_id", "text"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused share of the assignment."""
    return fill_report(p6_containers(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut."""
    return p6_containers(spark, d).where(F.col("piece") == 1).select(F.col("doc_id").cast("bigint").alias("doc_id"))


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: one row per document and repeat, with its shard."""
    return _mixture(spark, d).rows


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of every source."""
    return _mixture(spark, d).report()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose target can't be met."""
    return _mixture(spark, d).report().where(~F.col("target_met")).select("source")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score and the evidence for it."""
    return score(table(spark, d, "documents"), table(spark, d, "labels"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Flagged documents per source."""
    return rates(p8_scores(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where(F.col("score") >= THRESHOLD).select(F.col("doc_id").cast("bigint").alias("doc_id"))


#: None of these is checked by SQL: tokens and neighbours have no SQL form (tests compare with brute force).
ORACLE_SQL: dict[str, str] = {}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_found": p6_found, "p6_containers": p6_containers, "p6_fill": p6_fill, "p7_found": p7_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
}
