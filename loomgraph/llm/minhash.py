"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document's set holds its distinct five-word shingles after A-Z is lower-cased;
one with fewer words has its whole word sequence as its only shingle, one
without words an empty set that is linked with nothing. Documents whose sets
have a Jaccard similarity of the threshold or more are linked, and the linked
ones make groups.

Signatures need two permutations only: an initial one, sigma, and one, pi, that
is applied after shifting sigma's value by k around the circle of 2**32 places,
for coordinate k. ``plan_bands`` picks the longest bands for which a pair at the
threshold is missed with a probability of 1e-6 at most.

Rows with equal sets are one node from the start, whatever their number; sets
are told apart by their size and two independent 64-bit sums over all shingles.
In each bucket of equal bands, members are first compared with the bucket's
smallest one only, and links become components. Members of a bucket that then
lie in *different* components are not compared pair by pair: two sets of the
threshold share one of the rarest shingles of either, so many that the rest
alone could not reach it. These rarest shingles are joined on their hashes, and
only pairs that share one, lie in different components and are of like size are
compared. Rarity is read from a table of ``PLACES`` counts over the shingles of
all such documents, which any order would make exact and this one makes few:
what a template gives to each of its pages comes last. So no link between
components is lost, and pages of one template give no pairs by that alone.
Verification takes the whole texts of documents that share a bucket with
another, never of all.

Edge cases: null texts have no words; rows with a null id are kept and get no
component; rows that share an id are one node, which links whatever its texts
link; an empty table gives an empty one; input columns named like an output are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import worker
from loomgraph.llm.columns import fresh, without
from loomgraph.llm.components import components
from loomgraph.llm.textkernel import VALUES_LOWER, VALUES_LOWER_AGAIN, WORD_BASE, WORD_BASE_AGAIN, Words, chunks, mix, window_hashes, window_owner
from loomgraph.session import prepare, scratch

#: Coordinates of a signature at most.
COORDINATES = 128
#: Chance of missing a pair at the threshold, at most.
MISS = 1e-6
#: Counts by which shingles of documents that are left over are ordered (a power of two; 8 bytes each are broadcast).
PLACES = 1 << 20


def plan_bands(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows of a band) for a threshold in per cent."""
    for rows in range(16, 0, -1):
        bands = coordinates // rows
        if bands and (1 - (percent / 100) ** rows) ** bands <= miss:
            return bands, rows
    raise ValueError("no banding reaches this threshold")


def _hashed(found: Words, values: np.ndarray, base: np.uint64, start: np.ndarray, short: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles at ``start``, then of the whole texts in ``short``."""
    words = found.hashes(values)
    hashes = window_hashes(words, width, base)[start] if len(start) else np.zeros(0, np.uint64)
    if not len(short):
        return hashes
    sizes, whole = np.diff(found.bounds)[short], np.zeros(len(short), np.uint64)
    for n in range(1, width):
        of = np.flatnonzero(sizes == n)
        if len(of):
            whole[of] = mix(window_hashes(words, n, base)[found.bounds[short[of]]] + np.uint64(n))
    return np.concatenate([hashes, whole])


def shingles(data: np.ndarray, offsets: np.ndarray, width: int, again: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hashes, counts, second hashes): the distinct shingles of each document of a chunk, ascending within it."""
    found = Words(data, offsets)
    owner, start = window_owner(found.bounds, width)
    sizes = np.diff(found.bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    hashes, owner = _hashed(found, VALUES_LOWER, WORD_BASE, start, short, width), np.concatenate([owner, short])
    n = len(sizes)
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    second = _hashed(found, VALUES_LOWER_AGAIN, WORD_BASE_AGAIN, start, short, width)[order[new]] if again else None
    return hashes[new], np.bincount(owner[new], minlength=n), second


def circulant_signatures(hashes: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash signatures of the non-empty sets, one row each."""
    counts = counts[counts > 0]
    at = np.cumsum(counts) - counts
    place = (hashes >> np.uint64(32)).astype(np.uint32)  # sigma: the mixed hash puts a shingle at a random place of the circle
    out = np.empty((len(counts), coordinates), np.uint32)
    t, half = np.empty_like(place), np.empty_like(place)
    for k in range(coordinates):
        np.add(place, np.uint32(k), out=t)  # shifted by k around the circle
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):  # pi: a bijection of 32-bit words
            np.right_shift(t, np.uint32(shift), out=half)
            np.bitwise_xor(t, half, out=t)
            np.multiply(t, np.uint32(factor), out=t)
        np.right_shift(t, np.uint32(16), out=half)
        np.bitwise_xor(t, half, out=t)
        np.minimum.reduceat(t, at, out=out[:, k])
    return out


def _sketch(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, s1, s2, bands): set size, a 128-bit fingerprint of the set, and one key for each band."""
    names = ["id", "n_shingles", "s1", "s2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start()
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                hashes, counts, second = shingles(data, offsets, width, again=True)
                some = np.flatnonzero(counts)
                keys, sums = np.zeros((len(some), bands), np.uint64), np.zeros((2, len(counts)), np.uint64)
                if len(some):
                    at = (np.cumsum(counts) - counts)[some]
                    sums[0, some] = np.add.reduceat(mix(hashes.copy()), at)
                    sums[1, some] = np.add.reduceat(mix(second), at)
                    values = circulant_signatures(hashes, counts, bands * rows).reshape(len(some), bands, rows)
                    keys[:] = np.arange(1, bands + 1, dtype=np.uint64)
                    for r in range(rows):
                        keys = mix((keys ^ values[:, :, r]) * np.uint64(0x9E3779B97F4A7C15))
                ends = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(np.where(counts > 0, bands, 0), out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(counts.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))], names=names
                )

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, "id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, common, total) of each pair, from the shingles of both whole texts.

    The joins are sort-merge joins at every size: texts are never broadcast, and AQE splits a hot ``b``.
    """
    heads = texts.join(pairs.select(F.col("b").alias("id")).distinct().hint("merge"), "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").join(heads.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start()
        head, known = None, None
        for batch in batches:
            common, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            heads = batch.column(1).to_pylist()
            for first, last, data, offsets in chunks(batch.column(2)):
                hashes, counts, _ = shingles(data, offsets, width)
                ends = np.cumsum(counts)
                for k in range(first, last):
                    if head != heads[k]:
                        _, _, one, bounds = next(chunks(batch.column(3)[k : k + 1]))
                        head, known = heads[k], shingles(one, bounds, width)[0]
                    mine = hashes[ends[k - first] - counts[k - first] : ends[k - first]]
                    if len(known) and len(mine):
                        at = np.searchsorted(known, mine)
                        at[at == len(known)] = 0
                        common[k] = int((known[at] == mine).sum())
                    total[k] = len(mine) + len(known) - common[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common), pa.array(total)], names=["a", "b", "common", "total"])

    return both.mapInArrow(run, "a long, b long, common long, total long")


def leftover_pairs(left: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b), a > b: pairs of ``left`` (id, component) in different components that share one of the rarest shingles of both."""
    spark = left.sparkSession
    there = texts.join(left.hint("merge"), "id").select("id", "component", "text")
    shift = np.uint64(64 - (PLACES.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start()
        seen = np.zeros(PLACES, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                seen += np.bincount((shingles(data, offsets, width)[0] >> shift).astype(np.int64), minlength=PLACES)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["place", "n"])

    # PLACES rows at most, whatever the corpus.
    counted = there.select("text").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(PLACES, np.int64)
    often[counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(often)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start()
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(2)):
                hashes, counts, _ = shingles(data, offsets, width)
                owner = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((hashes, sent.value[(hashes >> shift).astype(np.int64)], owner))
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
                most = counts - -(-counts * percent // 100) + 1  # of n shingles, n - ceil(percent of n) + 1
                some = place < most[owner]
                of = owner[some]
                at = pa.array(of + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(counts[of]), pa.array(hashes[order][some].view(np.int64))], names=["id", "component", "n", "hash"])

    keys = there.mapInArrow(rarest, "id long, component long, n long, hash long")
    x, y = (keys.select("hash", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "component", "n")]) for side in "xy")
    fits = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    pairs = x.join(y, "hash").where((F.col("component_x") < F.col("component_y")) & fits)
    return pairs.select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5, coordinates: int = COORDINATES) -> DataFrame:
    """Adds ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept`` (whether that is the row's own)."""
    docs = without(docs, ["n_shingles", "component_id", "kept"])
    groups = groups_of(docs, doc_id=doc_id, text=text, percent=percent, width=width, coordinates=coordinates)
    node = fresh(docs, "node")
    joined = docs.withColumn(node, F.col(f"`{doc_id}`").cast("long")).join(groups.withColumnRenamed("id", node), node, "left")
    kept = F.coalesce(F.col(node) == F.col("component_id"), F.lit(True))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "n_shingles", "component_id", kept.alias("kept"))


def groups_of(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5, coordinates: int = COORDINATES) -> DataFrame:
    """(id, n_shingles, component_id), one row for each distinct id that isn't null."""
    spark = prepare(docs.sparkSession)
    bands, rows = plan_bands(percent, coordinates)
    at = scratch(spark, "minhash")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    sketch = kept(_sketch(docs.where(F.col(f"`{doc_id}`").isNotNull()), doc_id, text, width, bands, rows), "sketch")
    filled = sketch.where("n_shingles > 0")
    same = ["n_shingles", "s1", "s2"]
    sets = filled.groupBy(*same).agg(F.min("id").alias("node"))
    ids = kept(sketch.select("id", *same).join(sets, same, "left").select("id", "n_shingles", "node"), "ids")
    nodes = filled.join(sets.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = nodes.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("size")).where("size > 1").select("key", "center")
    members = kept(nodes.join(buckets, "key"), "members")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(members.select("id").distinct().hint("merge"), "id", "left_semi")
    texts = kept(texts, "texts")
    size_of = members.where("id = center").select("center", F.col("n").alias("center_n")).distinct()
    fits = F.least("n", "center_n") * 100 >= F.greatest("n", "center_n") * percent
    stars = members.where("id <> center").select("id", "center", "n").distinct().join(size_of, "center").where(fits).select(F.col("id").alias("a"), F.col("center").alias("b"))
    first = kept(_verified(stars.distinct(), texts, width), "first")
    is_link = F.col("common") * 100 >= F.col("total") * percent
    # An id with several texts is one node: its nodes are linked.
    least = ids.where("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("id", "b")
    own = ids.join(least, "id").select(F.col("node").alias("a"), "b")
    found = kept(components(first.where(is_link).select("a", "b").union(own)), "found")

    # What remains: members of one bucket in different components.
    placed = members.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = kept(placed.join(mixed, "key", "left_semi").select("id", "component").distinct(), "left")
    if not left.isEmpty():
        pairs = kept(leftover_pairs(left, texts, width, percent).join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        second = kept(_verified(pairs, texts, width).where(is_link), "second")
        if not second.isEmpty():
            found = components(second.select("a", "b").union(found.select("node", "component")))
    one = ids.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.min("node").alias("node"))
    return one.join(found.select("node", "component"), "node", "left").select("id", "n_shingles", F.coalesce("component", "node", "id").alias("component_id"))
