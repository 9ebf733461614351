"""Benchmark analytics: validity, grades, cells, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRADES = ("incorrect", "partial", "correct")


def grade_rank(grade: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, GRADES)), grade)


def invalid_reason(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule that applies."""
    out = None
    for condition, reason in rules:
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent grade per key, of equal ones the lower; with its share."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -grade_rank(F.col(value)))).alias(value), F.max("n").alias("votes"), F.sum("n").alias("of"))


def cell(df: DataFrame, keys: list[str]) -> DataFrame:
    """Measures of valid runs, and counts of all of them, per cell."""
    valid = ~F.col("invalid")
    return df.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.count_if(valid).alias("valid"), F.coalesce(F.median(F.when(valid, F.col("tokens"))), F.lit(0.0)).alias("tokens"), F.coalesce(F.median(F.when(valid, F.col("cost"))), F.lit(0.0)).alias("cost"), F.round(F.avg(F.when(valid, F.col("share"))), 6).alias("share"),
    )


def percent(arm: Column, reference: Column) -> Column:
    """Signed whole per cent against the reference; a dash without one."""
    change = F.floor((arm - reference) / reference * 100 + 0.5).cast("long")
    return F.when(F.coalesce(reference, F.lit(0.0)) == 0, "—").otherwise(F.concat(F.when(change > 0, "+").otherwise(""), change.cast("string"), F.lit("%")))
