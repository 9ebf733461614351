"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts and benchmark items are lower-cased and their white space is squeezed. A
place of a text matches an item of m characters if it aligns with all of it
within e = EDIT_RATE * m edits. By the q-gram lemma such a place shares at least
t = m + 1 - q * (e + 1) of the item's q-grams, all on diagonals that lie within
e of one another. So shared q-grams are counted in diagonal bands 2 * (e + 1)
wide that overlap by half, which holds any such set in one band; bands with t or
more are aligned (a dynamic programme over the band's diagonals only), and those
within the budget are matches.

Items of fewer than ``MIN_CHARS`` characters have a budget of no edits and are
matched exactly, where they stand between white space or a text's ends.

The benchmark is a query set: it is taken in blocks of ``BLOCK_CHARS`` items'
characters at most, whatever its size, and each block is searched in all texts;
only one block is broadcast at a time. One block, as nearly all benchmarks are,
is one stage over the texts, without a shuffle. Of several blocks, each is a job
that writes the texts' matches under two hashes of the text, and what was found
is joined to the rows at the end. Long texts are searched in overlapping parts,
and grams that very many items share are expanded ``SLICE`` hits at a time, so
memory follows neither a text's length nor how often a gram occurs.

Edge cases: null texts have no match; null and blank items are not searched for;
items that share a text each match; repeated rows get the same result; an empty
table or benchmark gives no matches; input columns named like an output are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm import worker
from loomgraph.llm.columns import fresh, without
from loomgraph.llm.textkernel import WORD_BASE, _powers, mix
from loomgraph.session import prepare, scratch

EDIT_RATE = 0.05
#: Length of grams, by the least length of items they serve.
GRAMS = ((48, 12), (16, 5))
MIN_CHARS = GRAMS[-1][0]
BLOCK_CHARS = 4_000_000
#: Shared grams that are placed at once.
SLICE = 1 << 21
#: Characters searched at once.
PART = 1 << 18

MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_OUT = 0xFFFFFFFF


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(WORD_BASE, len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
    return mix((sums[q:] - sums[:-q]) * inverse[:n])


def _edges(key: np.ndarray, n: np.ndarray | None, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sums of n, least first, greatest last) by key; n is 1 each if not given."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key))) if n is None else np.add.reduceat(n[order], at)
    return key[at], count, np.minimum.reduceat(first[order], at), np.maximum.reduceat(last[order], at)


class Exact:
    """Items that are matched as they are, between white space."""

    exact = True

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.codes = [_codes(t) for _, t in items]
        self.reach = max(map(len, self.codes)) + 1
        #: By length: hashes in order, and the items that have them.
        self.known: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in sorted({len(c) for c in self.codes}):
            some = [k for k, c in enumerate(self.codes) if len(c) == size]
            hashes, where = np.unique(np.concatenate([gram_hashes(self.codes[k], size) for k in some]), return_inverse=True)
            having: list[list[int]] = [[] for _ in hashes]
            for k, w in zip(some, where.ravel(), strict=True):
                having[w].append(k)
            self.known[size] = (hashes, having)

    def search(self, codes: np.ndarray, owner_of: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """As ``Index.search``. A part's first place counts as a beginning; whether it is one, the caller knows."""
        wall = (codes == 32) | (codes == _OUT)
        for size, (hashes, having) in self.known.items():
            mine = gram_hashes(codes, size)
            at = np.searchsorted(hashes, mine)
            at[at == len(hashes)] = 0
            hits = np.flatnonzero(hashes[at] == mine)
            begins = np.isin(hits, owner_of) | wall[np.maximum(hits - 1, 0)]
            ends = np.append(wall, True)[hits + size]
            for pos in hits[begins & ends].tolist():
                p = int(np.searchsorted(owner_of, pos, side="right")) - 1
                start = pos - int(owner_of[p])
                for k in having[int(at[pos])]:
                    if np.array_equal(codes[pos : pos + size], self.codes[k]):
                        yield p, k, 0, start, start + size


class Index:
    """The q-grams of a block of items that share one q."""

    exact = False

    def __init__(self, items: list[tuple[int, str]], q: int):
        self.q, self.ids = q, [i for i, _ in items]
        self.codes = [_codes(t) for _, t in items]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.floor(self.size * EDIT_RATE).astype(np.int64)
        self.need = self.size + 1 - q * (self.budget + 1)
        hashes = [gram_hashes(c, q) for c in self.codes]
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.hash, at = np.unique(flat[order], return_index=True)
        self.at, self.many = at.astype(np.int32), np.diff(np.append(at, len(flat))).astype(np.int32)
        self.bits = int(np.ceil(np.log2(len(self.hash)))) + 6
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.hash >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.reach = int((self.size + 2 * self.budget).max()) + 1

    def search(self, codes: np.ndarray, owner_of: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(part, item, edits, start, end) in texts laid end to end; ``owner_of`` gives where each part begins."""
        q = self.q
        hashes = gram_hashes(codes, q)
        hits = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(hits):
            return
        at = np.searchsorted(self.hash, hashes[hits])
        at[at == len(self.hash)] = 0
        right = self.hash[at] == hashes[hits]
        hits, at = hits[right], at[right]
        low, span = -int(self.size.max()) - 2, len(codes) + int(self.size.max()) + 4
        upto = np.cumsum(self.many[at], dtype=np.int64)
        cuts = np.unique(np.searchsorted(upto, np.arange(SLICE, int(upto[-1]) if len(upto) else 0, SLICE)))
        votes = [self._votes(hits[a:b], at[a:b], owner_of, low, span) for a, b in zip([0, *cuts], [*cuts, len(hits)], strict=True) if a < b]
        if not votes:
            return
        found, count, first, last = votes[0] if len(votes) == 1 else _edges(*(np.concatenate(c) for c in zip(*votes, strict=True)))
        good = np.flatnonzero(count >= self.need[found // span % len(self.ids)])
        ends = np.append(owner_of[1:], len(codes))
        for g in good:
            k = int(found[g])
            i, p = k // span % len(self.ids), k // span // len(self.ids)
            edits = self.align(codes, int(owner_of[p]), int(ends[p]), i, (k % span + low) * (int(self.budget[i]) + 1))
            if edits <= self.budget[i]:
                yield p, i, edits, int(first[g] - owner_of[p]), int(last[g] + q - owner_of[p])

    def _votes(self, hits: np.ndarray, at: np.ndarray, owner_of: np.ndarray, low: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key of part, item and band; shared grams; first and last place of one) of some of the places that share a gram."""
        many = self.many[at].astype(np.int64)
        pos = np.repeat(hits, many)
        entry = np.repeat(self.at[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        item = self.item[entry].astype(np.int64)
        band = (pos - self.place[entry]) // (self.budget[item] + 1)
        part = np.searchsorted(owner_of, pos, side="right") - 1
        key = (part * len(self.ids) + item) * span + (band - low)
        both = np.concatenate([key, key - 1])  # band k holds steps k and k + 1
        where = np.concatenate([pos, pos])
        return _edges(both, None, where, where)

    def align(self, codes: np.ndarray, start: int, end: int, i: int, low: int) -> int:
        """Least edits of the whole item against the text on the band's diagonals; budget + 1 if beyond it."""
        pattern, budget = self.codes[i], int(self.budget[i])
        width, m = 2 * (budget + 1), len(self.codes[i])
        text = np.full(m + width, _OUT, np.uint32)
        a, b = max(low, start), min(low + m + width, end)
        if a < b:
            text[a - low : b - low] = codes[a:b]
        windows = np.lib.stride_tricks.sliding_window_view(text, m)[:width]
        same = windows == pattern
        if same.all(axis=1).any():
            return 0
        cost = np.zeros(width, np.int64)
        ramp = np.arange(width)
        for j in range(m):
            step = cost + ~same[:, j]
            step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
            cost = np.minimum.accumulate(step - ramp) + ramp
            if j % 16 == 0 and cost.min() > budget:
                return budget + 1
        return min(int(cost.min()), budget + 1)


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[Index | Exact]]:
    """Indexes of successive blocks of the benchmark; one block is in memory at a time."""
    block: list[tuple[int, str]] = []
    size = 0

    def made() -> list[Index | Exact]:
        out, upper = [], np.inf
        for least, q in GRAMS:
            if some := [(i, t) for i, t in block if least <= len(t) < upper]:
                out.append(Index(some, q))
            upper = least
        if some := [(i, t) for i, t in block if len(t) < MIN_CHARS]:
            out.append(Exact(some))
        return out

    for row in benchmark.select(F.col(item_id).cast("long"), F.col(text)).dropna().toLocalIterator():
        item = normal(row[1])
        if not item:
            continue
        if block and size + len(item) > BLOCK_CHARS:
            yield made()
            block, size = [], 0
        block.append((row[0], item))
        size += len(item)
    if block:
        yield made()


def _search(texts: list[str], indexes: list[Index | Exact], out: list[dict[int, tuple[int, int, int]]]) -> None:
    """Adds each text's best match of each item to ``out``."""
    for index in indexes:
        group: list[np.ndarray] = []
        names: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            begins = np.cumsum([0, *[len(g) for g in group[:-1]]])
            for p, i, edits, start, end in index.search(np.concatenate(group), begins):
                text, shift = names[p]
                if index.exact and shift and not start:
                    continue  # the part before has this place, with what stands before it
                found = (edits, start + shift, end + shift)
                item = index.ids[i]
                if item not in out[text] or found < out[text][item]:
                    out[text][item] = found
            group.clear()
            names.clear()

        # Fences keep grams from running into the next text; a part's end is not a text's.
        fence, cut = np.array([_OUT], np.uint32), np.array([_OUT - 1], np.uint32)
        for k, text in enumerate(texts):
            codes = _codes(text)
            for a in range(0, max(len(codes), 1), PART):
                if a and len(codes) - a < index.reach:
                    break
                piece = codes[a : a + PART + index.reach]
                group.append(np.concatenate([piece, fence if a + len(piece) == len(codes) else cut]))
                names.append((k, a))
                size += len(piece) + 1
                if size >= PART:
                    flush()
                    size = 0
        if group:
            flush()


_FOUND = dict[int, tuple[int, int, int]]


def _rows(found: list[_FOUND]) -> pa.Array:
    return pa.array([[{"item_id": i, "edits": e, "start": a, "end": b} for i, (e, a, b) in sorted(x.items())] for x in found], to_arrow_type(MATCHES))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", matches: str = "matches") -> DataFrame:
    """Adds the items found in each text: id, edits, and where in the normalised text, ordered by id."""
    docs = without(docs, [matches])
    spark = prepare(docs.sparkSession)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(matches, MATCHES)])
    taken = blocks(benchmark, item_id, item_text)
    block, following = next(taken, None), next(taken, None)
    if block is None:
        return docs.withColumn(matches, F.array().cast(MATCHES))
    if following is None:
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker.start()
            for batch in batches:
                found: list[_FOUND] = [{} for _ in range(batch.num_rows)]
                _search([normal(x) for x in batch.column(text).to_pylist()], sent.value, found)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], _rows(found)], names=[*names, matches])

        return docs.mapInArrow(search, schema)

    at = scratch(spark, "contaminated")
    one, two = (F.xxhash64(F.lit(seed), F.col(f"`{text}`")) for seed in (1, 2))
    texts = docs.select(one.alias("one"), two.alias("two"), F.col(f"`{text}`").alias("text"))

    def searcher(sent: Any) -> Any:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker.start()
            for batch in batches:
                found: list[_FOUND] = [{} for _ in range(batch.num_rows)]
                _search([normal(x) for x in batch.column(2).to_pylist()], sent.value, found)
                some = [k for k, x in enumerate(found) if x]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), batch.column(1).take(pa.array(some, pa.int64())), _rows([found[k] for k in some])], names=["one", "two", "m"])

        return run

    def searched(block: list[Index | Exact]) -> None:
        sent = spark.sparkContext.broadcast(block)
        texts.mapInArrow(searcher(sent), T.StructType([T.StructField("one", T.LongType()), T.StructField("two", T.LongType()), T.StructField("m", MATCHES)])).write.mode("append").parquet(at)
        sent.destroy()

    while block is not None:
        searched(block)
        block, following = following, next(taken, None)
    each = spark.read.parquet(at).select("one", "two", F.explode("m").alias("m")).distinct()
    found = each.groupBy("one", "two").agg(F.array_sort(F.collect_list("m")).alias("m"))
    a, b = fresh(docs, "one"), fresh(docs, "two")
    joined = docs.withColumns({a: one, b: two}).join(found.select(F.col("one").alias(a), F.col("two").alias(b), F.col("m").alias(matches)), [a, b], "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(matches), F.array().cast(MATCHES)).alias(matches))
