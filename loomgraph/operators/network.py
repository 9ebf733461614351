"""Measures of the file graph: fans, ranks, regions, communities, bounded traces."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.session import checkpoint, settled


def running(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the running sum of a column, the row's own value included, over a total order of rows.

    Rows are sorted in ranges, each of which adds up its own; what comes before a range is added from one row per
    range. Partitions of the sorted rows stay as they are between the two, as they are written in between.
    """
    placed = checkpoint(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy("_range").agg(F.sum(value).alias("_t"))  # one row for each range
    before = totals.select("_range", F.coalesce(F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(name, own).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def merged(links: DataFrame, imports: DataFrame) -> DataFrame:
    """(a, b, n): calls and resolved imports together, without self-loops."""
    more = imports.where("to_path IS NOT NULL").select(F.col("from_path").alias("a"), F.col("to_path").alias("b"), "n")
    return links.select("a", "b", "n").union(more).where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def fans(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct neighbours of each node (``path``) on either side; links are distinct pairs."""
    both = links.where("a <> b").select(F.col("a").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(links.where("a <> b").select("b", F.lit(0), F.lit(1)))
    sums = both.groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.join(sums, "path", "left").fillna(0, ["fan_in", "fan_out"])


def rank_normalise(df: DataFrame, column: str, score: str = "score") -> DataFrame:
    """Tie-averaged rank from 0 to 1, 0.5 for a single row.

    Ranks come from counts of distinct values. These are cut into ranges by ``running``, so no task holds
    them all.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("c"))
    below = running(counts, [column], "c", "r").withColumn("r", F.col("r") - F.col("c"))
    total = df.agg(F.count("*").alias("n"))
    placed = below.join(F.broadcast(total), how="inner")
    value = F.when(F.col("n") <= 1, F.lit(0.5)).otherwise((2 * F.coalesce("r", F.lit(0)) + F.col("c") - 1) / 2 / (F.col("n") - 1))
    return df.join(placed.select(column, value.alias(score)), column)


def region_flow(links: DataFrame, regions: DataFrame) -> DataFrame:
    """Edges within each region, into it and out of it. ``regions``: (path, region)."""
    a = regions.select(F.col("path").alias("a"), F.col("region").alias("ra"))
    b = regions.select(F.col("path").alias("b"), F.col("region").alias("rb"))
    pairs = links.join(a, "a").join(b, "b").groupBy("ra", "rb").agg(F.count("*").alias("e"))
    inside = F.col("ra") == F.col("rb")
    both = pairs.select(F.col("ra").alias("region"), F.when(inside, F.col("e")).otherwise(0).alias("i"), F.lit(0).cast("long").alias("b"), F.when(inside, 0).otherwise(F.col("e")).alias("o")).union(pairs.where(~inside).select("rb", F.lit(0).cast("long"), "e", F.lit(0).cast("long")))
    return both.groupBy("region").agg(F.sum("i").alias("internal"), F.sum("b").alias("inbound"), F.sum("o").alias("outbound"))


def region_stats(links: DataFrame, regions: DataFrame, digits: int | None = 6) -> DataFrame:
    """Share of files, foundation (inbound among crossing edges, 0.5 without any) and density per region."""
    counts = regions.groupBy("region").agg(F.count("*").alias("files"))
    total = regions.agg(F.count("*").alias("all"))
    crossing = F.coalesce(F.col("inbound") + F.col("outbound"), F.lit(0))
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    joined = counts.join(region_flow(links, regions), "region", "left").join(F.broadcast(total), how="inner")
    return joined.select("region", "files", cut(F.col("files") / F.col("all")).alias("share"), cut(F.when(crossing == 0, F.lit(0.5)).otherwise(F.col("inbound") / crossing)).alias("foundation"), cut(F.coalesce("internal", F.lit(0)) / F.col("files")).alias("density"))


def file_trace(links: DataFrame, roots: DataFrame, near: str, far: str, hops: int, fan: int) -> DataFrame:
    """Edges of the shortest-path graph outwards from roots (``path``), the ``fan`` heaviest per node and hop."""
    seen = frontier = checkpoint(roots.select("path"))
    out = None
    for hop in range(1, hops + 1):
        order = Window.partitionBy(near).orderBy(F.desc("n"), far)
        ranked = links.join(frontier.withColumnRenamed("path", near), near).withColumn("k", F.row_number().over(order)).where(F.col("k") <= fan)
        found = checkpoint(ranked.join(seen.withColumnRenamed("path", far), far, "left_anti").select("a", "b", "n", F.lit(hop).alias("hop")))
        out = found if out is None else out.union(found)
        frontier = checkpoint(found.select(F.col(far).alias("path")).distinct())
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return out


#: Roots, links of one file and hop, and edges of a trace, at most: an answer is one picture.
MOST_ROOTS, MOST_FAN, MOST_EDGES = 60, 24, 1600


def bounded_trace(links: DataFrame, roots: DataFrame, hops: int, direction: str = "out", fan: int = MOST_FAN, budget: int = MOST_EDGES) -> DataFrame:
    """(flow, hop, a, b, n, slot): edges of the shortest-path graphs out of roots (flow 1), into them (-1), or both.

    ``roots``: (path, pos), ranked; the first ``MOST_ROOTS`` count. Of each file the ``fan`` heaviest links are
    followed; edges are taken in the order of their near ends, then of weight, up to the budget, half of it each
    way for both. Frontiers are as small as the budget, so nothing but ``links`` is large. ``slot`` is when an edge
    shows: callers first, nearest last, then callees.
    """
    both = direction == "both"
    lead = 0 if direction == "out" else hops
    out = None
    for flow, near, far in ((-1, "b", "a"), (1, "a", "b")):
        if direction == ("out" if flow < 0 else "in"):
            continue
        slot = F.lit(lead) - F.col("hop") if flow < 0 else F.lit(lead - 1) + F.col("hop")
        part = _one_way(links, roots, near, far, hops, fan, budget // 2 if both else budget)
        part = part.select(F.lit(flow).alias("flow"), "hop", "a", "b", "n", slot.alias("slot"))
        out = part if out is None else out.union(part)
    return out


def _one_way(links: DataFrame, roots: DataFrame, near: str, far: str, hops: int, fan: int, left: int) -> DataFrame:
    frontier = checkpoint(roots.orderBy("pos", "path").limit(MOST_ROOTS).select("path", F.col("pos").cast("long").alias("pos")))
    seen, out = frontier.select("path"), None
    for hop in range(1, hops + 1):
        # A frontier has at most as many files as there are roots, or edges in the budget.
        near_end = F.broadcast(frontier.select(F.col("path").alias(near), "pos"))
        heaviest = Window.partitionBy(near).orderBy(F.desc("n"), far)
        ranked = links.join(near_end, near).withColumn("k", F.row_number().over(heaviest)).where(F.col("k") <= fan)
        new = ranked.join(F.broadcast(seen.withColumnRenamed("path", far)), far, "left_anti")
        kept = checkpoint(new.orderBy("pos", "k").limit(max(left, 0)).select("a", "b", "n", F.lit(hop).alias("hop"), "pos", "k"))
        out = kept if out is None else out.union(kept)
        left -= kept.count()
        if left <= 0 or hop == hops:
            break
        first = kept.groupBy(F.col(far).alias("path")).agg(F.min(F.struct("pos", "k")).alias("at"))
        frontier = checkpoint(first.select("path", (F.col("at.pos") * (fan + 1) + F.col("at.k")).alias("pos")))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("path"))
    return out


def hop_of(traced: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """(path, hop): hops from the roots, whichever way is nearer; 0 for roots, -1 for what the trace doesn't touch."""
    ends = traced.select(F.when(F.col("flow") > 0, F.col("b")).otherwise(F.col("a")).alias("path"), "hop").union(roots.select("path", F.lit(0)))
    nearest = ends.groupBy("path").agg(F.min("hop").alias("hop"))
    return files.select("path").join(nearest, "path", "left").select("path", F.coalesce("hop", F.lit(-1)).alias("hop"))


def label_propagation(links: DataFrame, regions: DataFrame, rounds: int = 12) -> DataFrame:
    """(path, region, community) by asynchronous label propagation within each region.

    The result depends on the order of updates, so it is sequential within a region; regions are
    bounded by how files are laid out, and edges between regions play no part.
    """
    a = regions.select(F.col("path").alias("a"), "region")
    b = regions.select(F.col("path").alias("b"), F.col("region").alias("other"))
    inner = links.join(a, "a").join(b, "b").where("region = other").select("region", "a", "b", "n")
    lone = regions.select("region", F.col("path").alias("a"), F.col("path").alias("b"), F.lit(0).cast("long").alias("n"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf.a) | set(pdf.b))
        near: dict[str, Counter] = {v: Counter() for v in nodes}
        for x, y, n in zip(pdf.a, pdf.b, pdf.n, strict=True):
            if x != y:
                near[x][y] += n
                near[y][x] += n
        label = {v: i for i, v in enumerate(nodes)}
        for _ in range(rounds):
            moved = False
            for v in nodes:
                votes: dict[int, float] = {}
                for u in sorted(near[v]):
                    votes[label[u]] = votes.get(label[u], 0.0) + near[v][u] / max(len(near[u]), 1)
                if votes:
                    best = min(votes, key=lambda c: (-votes[c], c))
                    if best != label[v]:
                        label[v], moved = best, True
            if not moved:
                break
        order: dict[int, int] = {}
        for v in nodes:
            order.setdefault(label[v], len(order))
        return pd.DataFrame({"region": pdf.region.iloc[0], "path": nodes, "community": [order[label[v]] for v in nodes]})

    return inner.union(lone).groupBy("region").applyInPandas(settle, "region long, path string, community long")


def dependency_paths(links: DataFrame, centrality: DataFrame, limit: int = 12, starts: int = 60, least: int = 3, most: int = 8) -> DataFrame:
    """(number, path): chains that follow the heaviest unvisited edge from the most central nodes.

    The walk is a join per step over at most ``starts`` chains; the choice among them is
    sequential and made on the driver, on that bounded list.
    """
    links = settled(links, "links")
    first = centrality.orderBy(F.desc("centrality"), "id").limit(starts)
    live = checkpoint(first.select("centrality", F.array("id").alias("path")))
    for _ in range(most - 1):
        tail = F.element_at("path", -1)
        step = live.withColumn("a", tail).join(links.join(F.broadcast(live.select(tail.alias("a")).distinct()), "a", "left_semi"), "a", "left").withColumn("b", F.when(~F.array_contains("path", F.col("b")), F.col("b")))
        best = step.groupBy("path", "centrality").agg(F.max_by("b", F.when(F.col("b").isNotNull(), F.struct("n", F.col("b")))).alias("b"))
        live = checkpoint(best.select("centrality", F.when(F.col("b").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("b"))).alias("path")))
    chosen, used = [], set()
    for row in sorted(live.collect(), key=lambda r: (-r["centrality"], r["path"])):
        path = row["path"]
        if least <= len(path) and sum(p in used for p in path) * 2 <= len(path) and len(chosen) < limit:
            chosen.append((len(chosen), ">".join(path)))
            used.update(path)
    return links.sparkSession.createDataFrame(chosen, "number long, path string")


def subsystems(paths: DataFrame, most: int = 7, largest: float = 0.25, compress: float = 0.8, least: float = 0.03) -> DataFrame:
    """(prefix, n): folders that split the files into a few groups, none much larger than the others.

    The files are only read for the prefix counts; what is decided on the driver are folders that
    hold ``least`` of the files or more, of which there are few at each level.
    """
    parts = F.split("path", "/")
    each = paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("prefix"))
    total = paths.count()
    counted = {r["prefix"]: r["n"] for r in each.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= least * total).collect()}

    def children(prefix: str) -> list[str]:
        depth = prefix.count("/") + 1 if prefix else 0
        return sorted(p for p in counted if p and p.count("/") == depth and p.startswith(prefix + "/" if prefix else ""))

    def narrowed(prefix: str) -> str:
        while True:
            big = [c for c in children(prefix) if counted[c] >= compress * counted[prefix]]
            if not big:
                return prefix
            prefix = big[0]

    groups = [narrowed("")] if counted else []
    while groups and len(groups) < most:
        groups.sort(key=lambda g: (-counted[g], g))
        split = next((g for g in groups if counted[g] > largest * total and len(children(g)) > 1), None)
        if split is None or len(groups) - 1 + len(children(split)) > most:
            break
        groups.remove(split)
        groups += [narrowed(c) for c in children(split)]
    rows = sorted(((g, counted[g]) for g in groups), key=lambda x: (-x[1], x[0]))
    return paths.sparkSession.createDataFrame(rows, "prefix string, n long")
