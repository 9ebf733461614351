"""Lookups of symbols and files, subject resolution, and the envelope's counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.patterns import symbol_glob


def by_offset(symbols: DataFrame, declarations: DataFrame, places: DataFrame) -> DataFrame:
    """The symbol that begins at (path, start), else the one whose later declaration does; null if none."""
    on = ["path", "start"]
    first = symbols.select(*on, F.col("id").alias("by_symbol"))
    later = declarations.select(*on, F.col("id").alias("by_declaration"))
    return places.join(first, on, "left").join(later, on, "left").select(*on, F.coalesce("by_symbol", "by_declaration").alias("id"))


def glob(symbols: DataFrame, pattern: str) -> DataFrame:
    """Symbols whose name or qualified name matches a glob in which ``*`` is any run and ``?`` any character."""
    regex = symbol_glob(pattern)
    return symbols.where(F.col("name").rlike(regex) | F.col("qualified").rlike(regex))


def best_tier(candidates: DataFrame, key: str = "subject", tier: str = "tier") -> DataFrame:
    """Candidates of the lowest tier that each subject has."""
    lowest = F.min(tier).over(Window.partitionBy(key))
    return candidates.withColumn("_lowest", lowest).where(F.col(tier) == F.col("_lowest")).drop("_lowest")


def resolve_subjects(symbols: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, id, tier): by id, then ``path#dotted``, then qualified name, and by bare name only if nothing else matches.

    Each tier is an equi-join, so no tier compares all subjects with all symbols.
    """
    tiers = [F.col("id"), F.concat_ws("#", "path", "qualified"), F.col("qualified"), F.col("name")]
    found = None
    for tier, key in enumerate(tiers):
        part = subjects.join(symbols.select(key.alias("subject"), F.col("id")), "subject").withColumn("tier", F.lit(tier))
        found = part if found is None else found.unionByName(part)
    return best_tier(found)


def resolve_paths(files: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, path): the path itself, else all that end in ``/subject``; a leading ``./`` is ignored.

    Suffixes are exploded on the file side, so the match is an equi-join.
    """
    wanted = subjects.withColumn("key", F.regexp_replace("subject", r"^\./", ""))
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    each = files.select("path", F.explode(suffixes).alias("key"))
    found = wanted.join(each, "key").withColumn("tier", F.when(F.col("key") == F.col("path"), 0).otherwise(1))
    return best_tier(found).select("subject", "path")


def budget(answer: DataFrame, limit: int) -> DataFrame:
    """returned, available, truncated of an answer cut to ``limit`` rows."""
    n = answer.agg(F.count("*").alias("available"))
    return n.select(F.least("available", F.lit(limit).cast("long")).alias("returned"), "available", (F.col("available") > limit).alias("truncated"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def winner(df: DataFrame, keys: list[str], rank: Column, values: list[str]) -> DataFrame:
    """The values of the row with the smallest rank per key, combined before the shuffle (no sort of whole groups)."""
    best = F.min_by(F.struct(*values), rank).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])
