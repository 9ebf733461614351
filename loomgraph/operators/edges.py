"""Call and reference edges of resolved subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL_ORDER = ["from_id", "to_id", "path", "line"]


def decoded(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the names of both ends."""
    a = symbols.select(F.col("id").alias("from_id"), F.col("name").alias("from_name"))
    b = symbols.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    return edges.join(a, "from_id").join(b, "to_id")


def callers(edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row per call site of a subject (``id``), ordered."""
    return edges.join(subjects.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi").orderBy(*CALL_ORDER)


def callees(edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row per call site in a subject (``id``), ordered."""
    return edges.join(subjects.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi").orderBy(*CALL_ORDER)


def steps(edges: DataFrame) -> DataFrame:
    """Distinct (from, to) with their ordered sites."""
    return edges.groupBy("from_id", "to_id").agg(F.sort_array(F.collect_list(F.struct("path", "line"))).alias("sites"))


def references(edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """References out of the subjects, and those into them from elsewhere."""
    ids = subjects.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").withColumn("direction", F.lit("out"))
    into = edges.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").withColumn("direction", F.lit("in"))
    return out.unionByName(into).orderBy("from_id", "to_id", "kind", "path", "line")


def follow_alias(edges: DataFrame, declared: DataFrame, alias: DataFrame) -> DataFrame:
    """Each edge's target: declared itself, else one alias hop away if that is declared."""
    direct = declared.select(F.col("id").alias("to_id"), F.col("id").alias("direct"))
    hop = alias.select(F.col("source").alias("to_id"), F.col("target").alias("hop")).join(declared.select(F.col("id").alias("hop")), "hop", "left_semi")
    return edges.join(direct, "to_id", "left").join(hop, "to_id", "left").select("from_id", "to_id", F.coalesce("direct", "hop").alias("target"))


def symbol_links(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """(a, b, via, n): calls are via 0, references via 1 + the number of their kind."""
    via = F.when(F.col("kind") == "references", 1).when(F.col("kind") == "extends", 2).when(F.col("kind") == "implements", 3).otherwise(4)
    both = calls.select("from_id", "to_id", F.lit(0).alias("via")).union(refs.select("from_id", "to_id", via))
    return both.groupBy(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "via").agg(F.count("*").alias("n"))
