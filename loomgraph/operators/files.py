"""Files: reports, membership, imports, counts, links between files and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.session import parts

KINDS = ("function", "class", "interface", "typeAlias", "enum", "variable", "method", "namespace")


def membership(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Each file's projects with their fidelity and cause."""
    return files.join(projects.select(F.col("config_path").alias("project"), "fidelity", "cause"), "project")


def listed(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Distinct values per key, sorted and joined by commas."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias(name))


def report(files: DataFrame, owners: DataFrame, projects: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Per file: projects, the canonical one with its fidelity, number of symbols, imports and importers."""
    canonical = membership(owners.where("canonical"), projects).select("path", F.col("project").alias("canonical"), "fidelity")
    columns = [
        listed(owners, "path", "project", "projects"),
        canonical,
        symbols.groupBy("path").agg(F.count("*").alias("symbols")),
        imports.groupBy(F.col("from_path").alias("path")).agg(F.count("*").alias("imports"), F.count_if(F.col("to_path").isNull()).alias("broken")),
        imports.where("to_path IS NOT NULL").groupBy(F.col("to_path").alias("path")).agg(F.count_distinct("from_path").alias("importers")),
    ]
    out = files.select("path")
    for part in columns:
        out = out.join(part, "path", "left")
    return out.fillna(0, ["symbols", "imports", "broken", "importers"])


def pivot_kinds(symbols: DataFrame) -> DataFrame:
    """Symbols of each kind per file, one column a kind; conditional counts, so no second pass finds the kinds."""
    return symbols.groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in KINDS])


def file_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(a, b, n): calls between files, by where caller and callee are declared."""
    a = symbols.select(F.col("id").alias("from_id"), F.col("path").alias("a"))
    b = symbols.select(F.col("id").alias("to_id"), F.col("path").alias("b"))
    # Symbol pairs rarely repeat, so they aren't counted first. Each exchange has as many parts as its rows ask for.
    n = parts(calls)
    callers = calls.select("from_id", "to_id").repartition(n, "from_id").join(a, "from_id").select("to_id", "a")
    return callers.repartition(n, "to_id").join(b, "to_id").select("a", "b").repartition(n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


def call_totals(links: DataFrame) -> DataFrame:
    """(path, calls_in, calls_out, calls_self) of file links."""
    own = F.col("a") == F.col("b")
    both = links.select(F.col("a").alias("path"), F.lit(0).cast("long").alias("i"), F.when(own, 0).otherwise(F.col("n")).alias("o"), F.when(own, F.col("n")).otherwise(0).alias("s")).union(
        links.where(~own).select(F.col("b"), F.col("n"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    )
    return both.groupBy("path").agg(F.sum("i").alias("calls_in"), F.sum("o").alias("calls_out"), F.sum("s").alias("calls_self"))


def top_links(links: DataFrame, k: int) -> DataFrame:
    """The k strongest links per (symbol, via, inbound); inbound links are the same ones from the other end."""
    both = links.select(F.col("a").alias("symbol"), F.col("b").alias("other"), "via", F.lit(False).alias("inbound"), "n").union(links.select("b", "a", "via", F.lit(True), "n"))
    order = Window.partitionBy("symbol", "via", "inbound").orderBy(F.desc("n"), "other")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def suffix_parents(symbols: DataFrame) -> DataFrame:
    """(id, parent): the nearest proper ancestor by dotted prefix in the same file.

    Each symbol's prefixes are exploded, so the join is on equality, not on ``startswith``.
    """
    names = F.split("dotted", r"\.")
    depth = F.size(names)
    prefixes = F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(names, 1, i), ".").alias("prefix"))))
    each = symbols.select("id", "path", F.explode(prefixes).alias("p")).select("id", "path", "p.depth", F.col("p.prefix").alias("dotted"))
    above = symbols.select("path", "dotted", F.col("id").alias("parent"))
    best = each.join(above, ["path", "dotted"]).groupBy("id").agg(F.max_by("parent", F.struct("depth", "parent")).alias("parent"))
    return symbols.select("id").join(best, "id", "left")


def skipped(path: Column, folders: list[str]) -> Column:
    """Whether a folder on the way to the file is one of those skipped."""
    names = F.split(path, "/")
    return F.arrays_overlap(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), F.array(*map(F.lit, folders)))


def match_score(path: Column, terms: list[str]) -> Column:
    """Search rank: terms in the file's name times 1000, less the path's length; null unless all terms are in the path."""
    low = F.lower(path)
    base = F.element_at(F.split(low, "/"), -1)
    every, score = F.lit(True), F.lit(0)
    for t in terms:
        every = every & low.contains(t)
        score = score + F.when(base.contains(t), 1000).otherwise(0)
    return F.when(every, (score - F.length(path)).cast("long"))
