"""Sums and counts of one column under a comparison, as plain aggregates."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Predicate(Enum):
    ALL = "all"
    GREATER = ">"
    GREATER_OR_EQUAL = ">="
    LESS = "<"
    LESS_OR_EQUAL = "<="
    EQUAL = "="


def _test(column: Column, predicate: Predicate, threshold: float) -> Column:
    return {
        Predicate.ALL: F.lit(True), Predicate.GREATER: column > threshold, Predicate.GREATER_OR_EQUAL: column >= threshold,
        Predicate.LESS: column < threshold, Predicate.LESS_OR_EQUAL: column <= threshold, Predicate.EQUAL: column == threshold,
    }[predicate]


def column_sum(df: DataFrame, column: str, predicate: Predicate = Predicate.ALL, threshold: float = 0.0) -> DataFrame:
    """One row with `total`: the sum where the predicate holds, 0 for no rows."""
    c = F.col(column).cast("double")
    return df.where(_test(c, predicate, threshold)).agg(F.coalesce(F.sum(c), F.lit(0.0)).alias("total"))


def column_count(df: DataFrame, column: str, predicate: Predicate = Predicate.ALL, threshold: float = 0.0) -> DataFrame:
    """One row with `n`: how many values satisfy the predicate."""
    c = F.col(column).cast("double")
    return df.where(c.isNotNull() & _test(c, predicate, threshold)).agg(F.count("*").alias("n"))
