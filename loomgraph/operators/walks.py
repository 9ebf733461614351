"""Walks over edges: breadth-first levels, reachability, path enumeration, components, ranks.

Visited-set walks are level loops of joins. Each level is written to the shared
folder (a reliable checkpoint), so plans stay short and a lost executor costs one
level. No neighbourhood or frontier is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.network import running
from loomgraph.session import checkpoint, parts, sent, settled, spread, stored


def levels(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of all that is reached from seeds (``id``) over (src, dst) in ``depth`` hops at most."""
    visited = frontier = checkpoint(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        reached = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = checkpoint(reached.join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if d % 6 == 0:  # one table again, so that a deep walk doesn't read as many as it has levels
            visited = checkpoint(visited.coalesce(max(frontier.rdd.getNumPartitions(), 1)))
    return visited


def impact(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth, through, source): inward walk that records the first discoverer.

    ``edges`` is (src, dst, kind, rank): src depends on dst; rank 0 for calls, 1 and up for
    references. A node is discovered by the frontier node that came first, calls before
    references, then by kind; the order within a level is that of discovery.
    """
    visited = frontier = checkpoint(seeds.select("id").distinct().withColumn("place", F.struct(F.lit(0).alias("depth"), F.array(F.col("id")).alias("trail"))).select("id", F.lit(0).alias("depth"), F.lit("changed").alias("through"), F.lit(None).cast("string").alias("source"), F.col("place.trail").alias("trail")))
    for d in range(1, depth + 1):
        found = edges.join(frontier.select(F.col("id").alias("dst"), "trail"), "dst")
        key = F.array_append(F.array_append(F.col("trail"), F.concat(F.col("rank").cast("string"), F.col("kind"))), F.col("src"))
        # min_by combines before the shuffle, so a node with very many dependants costs no sort of them.
        first = found.groupBy(F.col("src").alias("id")).agg(F.min_by(F.struct(F.col("kind").alias("through"), F.col("dst").alias("source"), key.alias("trail")), key).alias("best"))
        new = first.join(visited.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "best.through", "best.source", "best.trail")
        frontier = checkpoint(new)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if d % 6 == 0:
            visited = checkpoint(visited.coalesce(max(frontier.rdd.getNumPartitions(), 1)))
    return visited.drop("trail")


#: Distinct edges up to which a walk may send all of them to each worker.
BROADCAST_EDGES = 1_000_000


def _reaches_from_broadcast(hops: DataFrame, asked: DataFrame, depth: int) -> DataFrame:
    """The same for a graph that was counted and is small: each start is searched by itself, all starts in parallel."""
    near: dict[str, list[str]] = {}
    for row in hops.toLocalIterator():
        near.setdefault(row["id"], []).append(row["dst"])
    sent = hops.sparkSession.sparkContext.broadcast(near)

    def search(table: pa.Table) -> pa.Table:
        start, wanted = table.column("a")[0].as_py(), table.column("b").to_pylist()
        left, seen, frontier = set(wanted), set(), [start]
        for _ in range(depth):
            frontier = list({n for v in frontier for n in sent.value.get(v, ())} - seen)
            seen.update(frontier)
            left.difference_update(frontier)
            if not frontier or not left:
                break
        return pa.table([table.column("a"), table.column("b"), pa.array([b not in left for b in wanted])], names=["a", "b", "holds"])

    return asked.groupBy("a").applyInArrow(search, f"a {asked.schema['a'].dataType.simpleString()}, b {asked.schema['b'].dataType.simpleString()}, holds boolean")


def reaches(edges: DataFrame, pairs: DataFrame, depth: int, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """(a, b, holds): whether b is reached from a by one hop or more, for all pairs at once.

    ``reaches(x, x)`` holds only through a cycle. A graph of ``broadcast_edges`` edges at most is
    sent to the workers; a larger one is walked by joins. Starts are numbered and go in groups of 64, a bit for each,
    so a node is met once a group and level however many of its starts come by. Edges are laid out by their
    sources once. Every few levels starts whose pairs are all settled leave the walk.
    """
    pairs = pairs.select("a", "b").distinct()
    hops = checkpoint(spread(edges.select(F.col("src").alias("id"), "dst"), "id").distinct())
    asked = checkpoint(pairs)
    if hops.count() <= broadcast_edges:
        return _reaches_from_broadcast(hops, asked, depth)
    numbered = running(asked.select("a").distinct().withColumn("one", F.lit(1).cast("long")), ["a"], "one", "k")
    starts = checkpoint(numbered.select("a", F.expr("(k - 1) DIV 64").alias("g"), F.expr("shiftleft(1L, CAST((k - 1) % 64 AS INT))").alias("m")))
    live = starts.select(F.col("a").alias("id"), "g", "m")
    seen = live.limit(0)
    for d in range(1, depth + 1):
        # The frontier is hashed, and the edges, which lie by source, pass it unsorted.
        step = hops.join(live.hint("shuffle_hash"), "id").groupBy(F.col("dst").alias("id"), "g").agg(F.bit_or("m").alias("m"))
        before = seen.groupBy("id", "g").agg(F.bit_or("m").alias("old"))
        new = step.join(before, ["id", "g"], "left").select("id", "g", F.expr("m & ~coalesce(old, 0L)").alias("m"))
        live = checkpoint(new.where("m <> 0"))
        if live.isEmpty():
            break
        seen = seen.union(live)
        if d % 6 == 0:
            seen = checkpoint(seen.groupBy("id", "g").agg(F.bit_or("m").alias("m")))
            left = _held(asked, starts, seen).where("NOT holds").select("g", "bit").groupBy("g").agg(F.bit_or("bit").alias("left"))
            live = checkpoint(live.join(left, "g").select("id", "g", F.expr("m & left").alias("m")).where("m <> 0"))
    return _held(asked, starts, seen).select("a", "b", "holds")


def _held(asked: DataFrame, starts: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs with the bit of their start, and whether what was seen at their end has it."""
    met = seen.groupBy(F.col("id").alias("b"), "g").agg(F.bit_or("m").alias("met"))
    bits = asked.join(starts.withColumnRenamed("m", "bit"), "a")
    return bits.join(met, ["b", "g"], "left").select("a", "b", "g", "bit", F.expr("coalesce(met, 0L) & bit <> 0").alias("holds"))


class TooManyPaths(Exception):
    """A walk has more live paths than its caller allows; nothing is cut silently."""


#: Live paths of one level, at most.
MOST_PATHS = 100_000_000


def paths(edges: DataFrame, roots: DataFrame, depth: int, most: int = MOST_PATHS) -> DataFrame:
    """(path, terminus) of all simple paths from roots (``id``) over distinct (src, dst).

    Paths may grow in number with every step; where a level has more than ``most``, ``TooManyPaths`` says so.

    A step back onto the path is kept and ends it as ``cycle``; a node without edges ends it as
    ``leaf``, at the bound too; one with edges at the bound as ``depth``.
    """
    out_edges = checkpoint(edges.select("src", "dst").distinct())
    has = out_edges.select(F.col("src").alias("tail")).distinct().withColumn("more", F.lit(True))
    live = roots.select(F.array("id").alias("path"), F.col("id").alias("tail"))
    ended = None

    def put(df: DataFrame, terminus: str) -> None:
        nonlocal ended
        part = df.select("path", F.lit(terminus).alias("terminus"))
        ended = part if ended is None else ended.union(part)

    for d in range(depth + 1):
        marked = checkpoint(live.join(has, "tail", "left"))
        put(marked.where("more IS NULL"), "leaf")
        going = marked.where("more").drop("more")
        if d == depth:
            put(going, "depth")
            break
        step = checkpoint(going.join(out_edges.withColumnRenamed("src", "tail"), "tail").select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("tail"), F.array_contains("path", F.col("dst")).alias("back")))
        put(step.where("back"), "cycle")
        live = step.where("NOT back").drop("back")
        n = live.count()
        if n > most:
            raise TooManyPaths(f"{n} paths of {d + 1} steps, {most} allowed: ask for a smaller depth or scope")
        if not n:
            break
    return ended.orderBy("path")


def _pagerank_in_one_task(links: DataFrame, nodes: DataFrame, rounds: int, damping: float) -> DataFrame:
    """The same for a graph that was counted and is small: one task iterates over arrays."""

    def iterate(table: pa.Table) -> pa.Table:
        node = table.filter(pc.is_null(table.column("b"))).column("a").combine_chunks()
        link = table.filter(pc.is_valid(table.column("b")))
        a, b = (pc.index_in(link.column(c), node).to_numpy() for c in ("a", "b"))
        w = link.column("n").to_numpy().astype(float)
        n = len(node)
        out = np.bincount(a, weights=w, minlength=n)
        w, dangling, rank = w / out[a], out == 0, np.full(n, 1.0 / n)
        for _ in range(rounds):
            into = np.bincount(b, weights=rank[a] * w, minlength=n)
            rank = (1 - damping) / n + damping * (into + rank[dangling].sum() / n)
        return pa.table([node, pa.array(rank)], names=["id", "rank"])

    rows = nodes.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).cast("long").alias("n")).union(links.select("a", "b", "n"))
    return rows.groupBy(F.lit(1).alias("one")).applyInArrow(iterate, "id string, rank double")


#: Nodes, counted, up to which all ranks are sent to each worker in a round: 32 MB.
SENT_RANKS = 4_000_000


def _pagerank_by_ranges(links: DataFrame, nodes: DataFrame, n: int, rounds: int, damping: float) -> DataFrame:
    """The same with links spread by their far ends: a round sends the ranks, 8 bytes a node, and each task adds up its own nodes.

    Links are numbers and lie as columns, so a round reads 16 bytes of each at most and moves none.
    """
    spark = links.sparkSession
    numbered = checkpoint(running(nodes.select("id", F.lit(1).cast("long").alias("one")), ["id"], "one", "k").select("id", (F.col("k") - 1).cast("int").alias("k")))
    number = lambda c: sent(numbered.select(F.col("id").alias(c), F.col("k").alias(f"k{c}")))
    near = links.join(number("a"), "a").join(number("b"), "b").select("ka", "kb", "n")
    out = numbered.join(near.groupBy(F.col("ka").alias("k")).agg(F.sum("n").alias("out")), "k", "left").select("k", "out").toArrow()
    weight = np.zeros(n)
    weight[out.column("k").to_numpy()] = out.column("out").to_pandas().fillna(0).to_numpy()
    placed = stored(near.repartition(parts(links), "kb").select("ka", "kb", F.col("n").cast("double").alias("n")), "ranked-links")
    dangling, rank = weight == 0, np.full(n, 1.0 / n)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(np.divide(rank, weight, out=np.zeros(n), where=~dangling))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            into = np.zeros(n)
            for batch in batches:
                a, b, w = (c.to_numpy() for c in batch.columns)
                np.add.at(into, b, held.value[a] * w)
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(into[at])], names=["k", "into"])

        got = placed.mapInArrow(add, "k long, into double").toArrow()
        into = np.bincount(got.column("k").to_numpy(), weights=got.column("into").to_numpy(), minlength=n)
        rank = (1 - damping) / n + damping * (into + rank[dangling].sum() / n)
        held.unpersist()
    ranks = spark.sparkContext.broadcast(rank)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranks.value[batch.column(1).to_numpy()])], names=["id", "rank"])

    return numbered.mapInArrow(named, f"id {nodes.schema['id'].dataType.simpleString()}, rank double")


def pagerank(links: DataFrame, nodes: DataFrame, rounds: int = 40, damping: float = 0.85, small: int = BROADCAST_EDGES, ranks: int = SENT_RANKS) -> DataFrame:
    """(id, rank) by weight-proportional PageRank; what dangling nodes hold is spread evenly. ``links``: (a, b, n).

    Up to ``small`` links and nodes, which are counted, one task iterates; up to ``ranks`` nodes a round sends all ranks
    to the links; beyond that each round is a join.
    """
    links = settled(links.select("a", "b", "n"), "links")
    n = nodes.count()
    if links.count() <= small and n <= small:
        return _pagerank_in_one_task(links, nodes, rounds, damping)
    if n <= ranks:
        return _pagerank_by_ranges(links, nodes, n, rounds, damping)
    total = F.sum("n").over(Window.partitionBy("a"))
    share = checkpoint(links.withColumn("w", F.col("n") / total).select(F.col("a").alias("id"), "b", "w"))
    base = checkpoint(nodes.join(share.select("id").distinct().withColumn("out", F.lit(True)), "id", "left").select("id", F.col("out").isNull().alias("dangling")))
    rank = base.withColumn("rank", F.lit(1.0 / max(n, 1)))
    spread = not base.where("dangling").isEmpty()
    for k in range(1, rounds + 1):
        # A counted, small table of ranks is sent to the edges; else both sides meet by a shuffle.
        into = share.join(F.broadcast(rank) if n <= small else rank, "id").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("into"))
        # Ranks are written before each sum, so that no round is computed twice.
        lost = rank.where("dangling").agg(F.sum("rank")).first()[0] if spread else 0.0
        rank = base.join(F.broadcast(into) if n <= small else into, "id", "left").select("id", "dangling", ((1 - damping) / n + damping * (F.coalesce("into", F.lit(0.0)) + lost / n)).alias("rank"))
        if spread or k % 8 == 0 or k == rounds:
            rank = checkpoint(rank)
    return rank.select("id", "rank")


def depth_from_entries(edges: DataFrame, nodes: DataFrame, bound: int = 1000) -> DataFrame:
    """(id, depth): hops from nodes without inbound edges; what is not reached has the greatest depth found."""
    entries = nodes.join(edges.where("src <> dst").select(F.col("dst").alias("id")), "id", "left_anti")
    found = levels(edges, entries, bound)
    deepest = found.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"))  # one row
    return nodes.join(found, "id", "left").join(F.broadcast(deepest), how="inner").select("id", F.coalesce("depth", "deepest").cast("long").alias("depth"))


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id, component, size) of nodes in cycles of two or more, by forward colouring and backward search.

    Each round drops nodes without an edge on one side, spreads the smallest id forwards to a
    fixpoint, and takes as a component what reaches its colour's root backwards within the colour.
    Edges lie by source and by target, so a level moves nodes and what they send, not the edges, and
    only nodes that changed send.
    """
    n = parts(edges)
    fwd = checkpoint(edges.where("src <> dst").select("src", "dst").repartition(n, "src").distinct())
    bwd = checkpoint(fwd.repartition(n, "dst"))
    done: DataFrame | None = None

    def without(gone: DataFrame, how: str) -> None:
        """Keeps edges whose ends are both (``left_semi``) or neither (``left_anti``) among the nodes ``id``."""
        nonlocal fwd, bwd
        at = lambda c: gone.select(F.col("id").alias(c)).hint("shuffle_hash")
        fwd = checkpoint(bwd.join(at("dst"), "dst", how).repartition(n, "src").join(at("src"), "src", how).select("src", "dst"))
        bwd = checkpoint(fwd.repartition(n, "dst"))

    for _ in range(rounds):
        while True:  # trimming
            sources, targets = fwd.select(F.col("src").alias("id")).distinct(), bwd.select(F.col("dst").alias("id")).distinct()
            alive = checkpoint(sources.join(targets, "id", "left_semi"))
            if alive.count() == sources.count() == targets.count():
                break
            without(alive, "left_semi")
        if fwd.isEmpty():
            break
        # All nodes that are left have edges both ways.
        colour = checkpoint(alive.repartition(n, "id").withColumn("c", F.col("id")))
        moved = colour
        while True:
            into = fwd.join(moved.select(F.col("id").alias("src"), "c").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = checkpoint(colour.join(into.repartition(n, "id"), "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")))
            colour, moved = new.select("id", "c"), new.where("moved").select("id", "c")
            if moved.isEmpty():
                break
        found = frontier = checkpoint(colour.where("id = c"))
        depth = 0
        while True:
            depth += 1
            sources = bwd.join(frontier.select(F.col("id").alias("dst"), "c").hint("shuffle_hash"), "dst").select(F.col("src").alias("id"), "c").distinct()
            frontier = checkpoint(colour.join(sources, ["id", "c"], "left_semi").join(found.select("id"), "id", "left_anti"))
            if frontier.isEmpty():
                break
            found = found.union(frontier)
            if depth % 6 == 0:
                found = checkpoint(found.coalesce(n))
        found = checkpoint(found.coalesce(n))
        done = found if done is None else done.union(found)
        without(found, "left_anti")
    if done is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    size = F.count("*").over(Window.partitionBy("c"))
    return done.withColumn("size", size).where("size > 1").select("id", F.col("c").alias("component"), "size")
