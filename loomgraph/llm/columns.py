"""Column names of operators: what they add replaces an input column of that name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without(df: DataFrame, added: list[str]) -> DataFrame:
    """The input without columns (in any letter case) that the operator is about to add."""
    taken = {c.lower() for c in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """A helper column's name that no input column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
