"""Timelines, lifetimes, churn, health and clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.network import running
from loomgraph.session import checkpoint, parts


def lifetimes(frames: DataFrame, key: list[str], frame: str) -> DataFrame:
    """(key, birth, death): first frame, and one after the last; gaps are swallowed."""
    return frames.groupBy(*key).agg(F.min(frame).alias("birth"), (F.max(frame) + 1).alias("death"))


def merge_timeline(frames: DataFrame, key: str, frame: str, counters: list[str], last: list[str]) -> DataFrame:
    """Per key: the largest of each counter, and attributes as the last frame has them."""
    return frames.groupBy(key).agg(*[F.max(c).alias(c) for c in counters], *[F.max_by(c, frame).alias(f"last_{c}") for c in last])


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def heat(x: Column) -> Column:
    return F.sqrt(F.least(F.lit(100.0), x) / 100)


def wear(maintainability: Column) -> Column:
    return clamp((85 - maintainability) / 35)


def visibility(at: Column, birth: Column, death: Column, ramp: float) -> Column:
    """How far something has faded in after its birth and not yet out before its death."""
    return clamp((at - birth) / ramp + 1) * clamp((death - at) / ramp)


def blend(values: DataFrame, key: str, frame: str, value: str, at: Column) -> DataFrame:
    """Linear interpolation between frames; clamped to the first and last."""
    along = Window.partitionBy(key).orderBy(frame)
    spans = values.select(key, F.col(frame).alias("f0"), F.col(value).alias("v0"), F.lead(frame).over(along).alias("f1"), F.lead(value).over(along).alias("v1"), F.lag(frame).over(along).alias("before"))
    t = at
    inside = (t >= F.col("f0")) & (F.col("f1").isNull() | (t < F.col("f1"))) | (F.col("before").isNull() & (t < F.col("f0")))
    value_at = F.when(F.col("f1").isNull() | (t <= F.col("f0")), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (t - F.col("f0")) / (F.col("f1") - F.col("f0")))
    return spans.where(inside).select(key, value_at.alias(value))


def sample_even(rows: DataFrame, order: list[str], count: int) -> DataFrame:
    """Evenly spaced rows: places round(k / (count - 1) * (n - 1)), halves up, each once.

    ``rows`` is a list of commits or the like; it is numbered range by range.
    """
    numbered = running(rows.withColumn("_one", F.lit(1)), order, "_one", "place").withColumn("place", (F.col("place") - 1).cast("int")).drop("_one")
    n = rows.agg(F.count("*").alias("n"))
    wanted = n.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.floor(k / F.lit(max(count - 1, 1)) * (F.col("n") - 1) + 0.5).cast("int"))).alias("place")).distinct()
    return numbered.join(F.broadcast(wanted), "place")


def mutual(links: DataFrame) -> DataFrame:
    """(path): what is linked with another one both ways. Each pair meets once, whichever way its links (a, b) go."""
    forth = F.col("a") < F.col("b")
    pairs = links.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), forth.cast("int").alias("way"))
    both = pairs.repartition(parts(links), "x", "y").groupBy("x", "y").agg(F.min("way").alias("back"), F.max("way").alias("forth")).where("back < forth")
    return both.select(F.explode(F.array("x", "y")).alias("path")).distinct()


def clone_groups(lines: DataFrame, least: int = 20) -> DataFrame:
    """(h, doc, n): lines of ``least`` characters or more that more than one document has."""
    per_doc = lines.where(F.length("line") >= least).groupBy(F.md5("line").alias("h"), "doc").agg(F.count("*").alias("n"))
    shared = per_doc.groupBy("h").agg(F.count("*").alias("docs")).where("docs > 1")
    return per_doc.join(shared, "h").select("h", "doc", "n")


def duplicated(groups: DataFrame) -> DataFrame:
    return groups.groupBy("doc").agg(F.sum("n").alias("lines"))


def clone_links(groups: DataFrame, most: int) -> DataFrame:
    """(a, b, lines): neighbours in each group's sorted documents, so a group of n gives n - 1 links.

    Groups are sorted in ranges, so a line that all documents have is spread over tasks; where a range ends within
    a group, the next range's first document of that group is the neighbour.
    """
    placed = checkpoint(groups.select("h", "doc").orderBy("h", "doc").withColumn("_range", F.spark_partition_id()))
    firsts = placed.groupBy("h", "_range").agg(F.min("doc").alias("first"))
    after = firsts.select("h", "_range", F.lead("first").over(Window.partitionBy("h").orderBy("_range")).alias("after")).where("after IS NOT NULL")
    near = F.lead("doc").over(Window.partitionBy("_range", "h").orderBy("doc"))
    pairs = placed.select("h", "_range", "doc", near.alias("near")).join(after, ["h", "_range"], "left")
    return pairs.select("doc", F.coalesce("near", "after").alias("b")).where("b IS NOT NULL").groupBy(F.col("doc").alias("a"), "b").agg(F.count("*").alias("lines")).orderBy(F.desc("lines"), "a", "b").limit(most)
