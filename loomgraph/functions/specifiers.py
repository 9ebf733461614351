"""Import specifiers: their package, and why one doesn't resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def package_of(specifier: Column) -> Column:
    """First segment, or two of a scoped name; null for relative and mapped specifiers."""
    return F.when(specifier.rlike(r"^(\.|/|~|#|@/)"), None).when(specifier.startswith("@"), F.regexp_extract(specifier, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(specifier, r"^([^/]+)", 1))


def causes(specifiers: DataFrame, on_disk: DataFrame, installed: DataFrame, declared: DataFrame) -> DataFrame:
    """(specifier, cause). A relative one is unmapped if it is on disk, else broken; one whose package is
    installed is unmapped or missing-generated by whether its path resolves; a declared one is unprepared."""
    known = specifiers.withColumn("package", package_of(F.col("specifier")))
    known = known.join(on_disk.select("specifier", F.lit(True).alias("disk")).distinct(), "specifier", "left")
    known = known.join(installed.select("package", F.col("subpath").alias("subpath")).distinct(), "package", "left").join(declared.select("package", F.lit(True).alias("named")).distinct(), "package", "left")
    cause = F.when(F.col("specifier").startswith("."), F.when(F.col("disk"), "unmapped").otherwise("broken")).when(F.col("subpath").isNotNull(), F.when(F.col("subpath"), "unmapped").otherwise("missing-generated")).when(F.col("named"), "unprepared").otherwise("broken")
    return known.select("specifier", cause.alias("cause"))
