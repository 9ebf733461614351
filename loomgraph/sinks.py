"""Files that readers of an index are given: the atlas of its files, their timeline, and the names in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import atlas, files, upkeep
from loomgraph.operators.labels import effective_wide
from loomgraph.schema import ENUMS

#: Links of each kind that an atlas shows.
MOST_LINKS = 20_000


def atlas_files(facts, skip: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """(path, size, kinds, role, generated, project, calls_in, calls_out, calls_self, refs_in, unresolved), one row per file of the repository."""
    of = lambda df, key, *aggs: df.groupBy(F.col(key).alias("path")).agg(*aggs)
    inside = upkeep.inside(facts.file)
    inside = inside.where(~files.skipped(F.col("path"), skip)) if skip else inside
    kinds = of(facts.symbol, "path", *[F.count_if(F.col("kind") == k).alias(f"k{i}") for i, k in enumerate(ENUMS["kind"])])
    links = files.file_edges(facts.call_edge, facts.symbol)
    own = F.col("a") == F.col("b")
    calls_out = of(links, "a", F.sum(F.when(~own, F.col("n"))).alias("calls_out"), F.sum(F.when(own, F.col("n"))).alias("calls_self"))
    calls_in = of(links.where(~own), "b", F.sum("n").alias("calls_in"))
    place = facts.symbol.select(F.col("id").alias("to_id"), F.col("path").alias("of"))
    refs = facts.reference_edge.join(place, "to_id").groupBy(F.col("of").alias("path")).agg(F.count("*").alias("refs_in"))
    lost = of(facts.unresolved_call, "path", F.count("*").alias("unresolved"))
    owner = facts.file_project.where("canonical").groupBy("path").agg(F.min("project").alias("project"))
    wide = effective_wide(facts.label).withColumnRenamed("node", "path")
    joined = inside.select("path", "size")
    for part in (kinds, calls_in, calls_out, refs, lost, owner, wide):
        joined = joined.join(part, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    counted = F.array(*[F.coalesce(f"k{i}", F.lit(0).cast("long")) for i in range(len(ENUMS["kind"]))]).alias("kinds")
    generated = (F.coalesce("authorship", F.lit("authored")) == "generated").alias("generated")
    return joined.select("path", "size", counted, F.coalesce("role", F.lit("source")).alias("role"), generated, "project", *[zero(c) for c in ("calls_in", "calls_out", "calls_self", "refs_in", "unresolved")])


def atlas_links(facts, most: int = MOST_LINKS) -> DataFrame:  # noqa: ANN001
    """(kind, a, b, n): the heaviest calls between files, and imports, ``most`` of each, as the picture has room for."""
    calls = files.file_edges(facts.call_edge, facts.symbol).where("a <> b").orderBy(F.desc("n"), "a", "b").limit(most)
    imports = facts.file_import.where("to_path IS NOT NULL AND from_path <> to_path").groupBy(F.col("from_path").alias("a"), F.col("to_path").alias("b")).agg(F.count("*").alias("n"))
    imports = imports.orderBy(F.desc("n"), "a", "b").limit(most)
    return calls.select(F.lit("calls").alias("kind"), "a", "b", "n").union(imports.select(F.lit("imports"), "a", "b", "n"))


def timeline(frames: DataFrame) -> DataFrame:
    """(path, birth, death, size): files of numbered frames (``frame, path, size``), with their largest size."""
    lives = atlas.lifetimes(frames, ["path"], "frame")
    return lives.join(frames.groupBy("path").agg(F.max("size").alias("size")), "path")


def names(facts, skip: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """(path, names, kinds, parents): the symbols of each file in the order of their places, with the place of each one's parent or -1."""
    mine = upkeep.inside(facts.symbol)
    mine = mine.where(~files.skipped(F.col("path"), skip)) if skip else mine
    listed = F.array_sort(F.collect_list(F.struct("start", "qualified", "name", "kind")))
    grouped = mine.groupBy("path").agg(listed.alias("s"))
    owner = lambda s: F.regexp_replace(s["qualified"], r"\.[^.]*$", "")
    parent = lambda s: F.when(s["qualified"].contains("."), F.array_position(F.col("s.qualified"), owner(s)).cast("int") - 1).otherwise(F.lit(-1))
    return grouped.select("path", F.col("s.name").alias("names"), F.col("s.kind").alias("kinds"), F.transform("s", parent).alias("parents"))


def write(path: str, **tables: DataFrame) -> None:
    """Tables as folders of JSON lines below a path."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
