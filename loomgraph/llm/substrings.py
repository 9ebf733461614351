"""Removal of long word sequences that an earlier document has already.

Rabin-Karp hashes of all windows of ``width`` words are counted in Spark, and
the words under windows that also start in a document with a smaller id are
removed; touching windows merge into maximal intervals.

How it is laid out: documents are spread over *units* of ``UNIT_BYTES`` of text
by a hash of their row, and are shuffled once. Three passes read that shuffle:

1. Each window has an *anchor*: the least hash among the runs of half its length
   in it. Equal windows have equal anchors, so a window whose anchor lies in one
   unit only occurs in no other. A unit sends each distinct anchor once (about
   one for every 13 words), Spark counts the units of each anchor, and units get
   back those of their anchors that another has too.
2. Of windows with such an anchor, a unit sends each distinct hash (128 bits)
   once, with the smallest id that has it. Spark takes the minimum over units,
   and a unit gets back the hashes that another unit has with a smaller id.
3. Each unit settles its own repeats, adds those it was told of, and merges the
   windows that go into intervals.

So what is sent follows what repeats, not the number of pairs of anything. A
hash that a third of all documents share is one row for each unit; the two
windows over such rows sort and spill. Partitions hold many units, and their
number is bounded by ``PARTITION_BYTES`` of text each.

A unit groups its windows in slices of ``SLICE`` of the first hash, so a worker
holds two hashes and two numbers for each window and the temporaries of one slice.

Windows are told apart by two independent 64-bit hashes; among n windows one is
taken for another with probability n / 2**128.

Edge cases: a null text has no words and an empty kept text; a document shorter
than the window keeps all; within one document, or among rows with the same id,
nothing counts as a repeat; a null id counts as larger than any other, so its
windows never remove another's; rows of one id or of no id are spread by their
text as well; an empty table gives an empty one; input columns named like an
output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from loomgraph.llm import worker
from loomgraph.llm.columns import fresh, without
from loomgraph.llm.textkernel import VALUES, VALUES_AGAIN, WORD_BASE, WORD_BASE_AGAIN, Words, chunks, sliding_min, window_hashes, window_owner
from loomgraph.session import prepare

#: Words of a window.
WIDTH = 50
#: Bytes of text to a unit, and to a partition where there are more than ``FEW`` units.
UNIT_BYTES = 16 << 20
PARTITION_BYTES = 1 << 30
FEW = 2_000
#: Windows of a unit that are sorted and grouped at once.
SLICE = 1 << 18

_LAST = np.iinfo(np.int64).max
_NONE = np.zeros(0, np.uint64)
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def layout(total: int, unit_bytes: int) -> tuple[int, int]:
    """(units, partitions) for so many bytes of text."""
    units = max(4, -(-total // unit_bytes))
    return units, units if units <= FEW else max(FEW, -(-total // PARTITION_BYTES))


def _runs(column: pa.ChunkedArray) -> Iterator[tuple[int, Words]]:
    """(number of the first row, words) of runs of whole texts."""
    rows = 0
    for part in column.chunks:
        for first, _, data, offsets in chunks(part):
            yield rows + first, Words(data, offsets)
        rows += len(part)


def _anchors(words: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window of a run of texts, by where it begins."""
    half = (width + 1) // 2
    return sliding_min(window_hashes(words, half), width - half + 1)


class _Unit:
    """The windows of a unit's documents: by where each begins, two hashes, and the rank of its document's id."""

    def __init__(self, table: pa.Table, doc_id: str, text: str, width: int, bits: int, shared: np.ndarray | None = None):
        """All windows, or those with an anchor in ``shared``, which is sorted."""
        ids = table.column(doc_id).combine_chunks().cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)
        self.known, ranks = np.unique(ids, return_inverse=True)
        # As many places as there can be words; those that stay unused are never touched and take no memory.
        most = table.column(text).nbytes // 2 + table.num_rows + 1
        self.one, self.two, self.starts, self.rank = np.empty(most, np.uint64), np.empty(most, np.uint64), np.empty(most, np.int32), np.empty(most, np.int32)
        bounds, words, n = [np.zeros(1, np.int64)], 0, 0
        for row, found in _runs(table.column(text)):
            owner, start = window_owner(found.bounds, width)
            if len(start):
                hashed = found.hashes(VALUES)
                if shared is not None:
                    at = np.searchsorted(shared, anchor := _anchors(hashed, width)[start])
                    at[at == len(shared)] = 0
                    some = np.flatnonzero(shared[at] == anchor) if len(shared) else np.zeros(0, np.int64)
                    owner, start = owner[some], start[some]
                if len(start):
                    to = slice(n, n := n + len(start))
                    self.one[to] = window_hashes(hashed, width)[start] >> np.uint64(64 - bits)
                    self.two[to] = window_hashes(found.hashes(VALUES_AGAIN), width, WORD_BASE_AGAIN)[start]
                    self.rank[to] = ranks[owner + row]
                    self.starts[to] = start + words
            bounds.append(found.bounds[1:] + words)
            words += len(found.starts)
        self.one, self.two, self.starts, self.rank = self.one[:n], self.two[:n], self.starts[:n], self.rank[:n]
        self.bounds, self.words, self.width, self.bits = np.concatenate(bounds), words, width, bits

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of equal windows, by slices of the first hash: windows in order, the group of each; both hashes and least rank of each group."""
        cuts = min(self.bits, (len(self.one) // SLICE).bit_length())
        for k in range(1 << cuts):
            first, last = k << self.bits - cuts, (k + 1 << self.bits - cuts) - 1
            at = np.flatnonzero((self.one >= np.uint64(first)) & (self.one <= np.uint64(last)))
            if not len(at):
                continue
            one, two = self.one[at], self.two[at]
            order = np.argsort(one)
            new = np.ones(len(order), bool)
            new[1:] = one[order[1:]] != one[order[:-1]]
            if (~new[1:] & (two[order[1:]] != two[order[:-1]])).any():  # equal first hashes of different windows
                order = np.lexsort((two, one))
                new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
            begin, at = np.flatnonzero(new), at[order]
            yield at, np.cumsum(new) - 1, one[order[begin]], two[order[begin]], np.minimum.reduceat(self.rank[at], begin)

    def covered(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which words lie under a window that a smaller id has, in this unit or, as the given hashes say, in another."""
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        most = int(np.unique(one, return_counts=True)[1].max(initial=0))
        begins = np.zeros(self.words, bool)
        for at, group, mine, again, least in self.groups():
            first = np.searchsorted(one, mine)
            elsewhere = np.zeros(len(mine), bool)
            for k in range(most):  # more than one only where first hashes of different windows are equal
                there = np.minimum(first + k, len(one) - 1)
                elsewhere |= (one[there] == mine) & (two[there] == again)
            begins[self.starts[at[elsewhere[group] | (self.rank[at] > least[group])]]] = True
        return widened(begins, self.width)


def widened(begins: np.ndarray, width: int) -> np.ndarray:
    """Which places lie in a run of ``width`` from one of those marked."""
    span = 1
    while span < width:
        step = min(span, width - span)
        wider = begins.copy()
        wider[step:] |= begins[:-step]
        begins, span = wider, span + step
    return begins


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64) if len(column) else _NONE


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, unit_bytes: int = UNIT_BYTES, bits: int = 64, added: tuple[str, str, str, str] = ("n_words", "n_removed", "removed", "kept")) -> DataFrame:
    """Adds ``n_words``, ``n_removed``, ``removed`` (word intervals, last one excluded) and ``kept`` (words joined by a space).

    ``added`` names these columns otherwise. ``bits`` of the first hash are used; fewer than 64
    only make it collide more often, as the tests do.
    """
    docs = without(docs, list(added))
    prepare(docs.sparkSession)
    unit = fresh(docs, "unit")
    units, parts = layout(docs.agg(F.sum(F.octet_length(f"`{text}`"))).first()[0] or 0, unit_bytes)
    names = docs.columns
    place = F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")), F.lit(units)).cast("int")
    spread = docs.withColumn(unit, place).repartition(parts, F.col(unit))

    def announce(key: tuple, table: pa.Table) -> pa.Table:
        worker.start()
        seen = [np.unique(_anchors(found.hashes(VALUES), width)[start]) for _, found in _runs(table.column(text)) if len(start := window_owner(found.bounds, width)[1])]
        anchors = np.unique(np.concatenate(seen)) if seen else _NONE
        return pa.table([pa.array(anchors.view(np.int64)), pa.array(np.full(len(anchors), key[0].as_py(), np.int32))], names=["anchor", unit])

    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        worker.start()
        found = _Unit(left, doc_id, text, width, bits, np.sort(_unsigned(right.column("anchor"))))
        out = asking.empty_table()
        for _, _, one, two, least in found.groups():
            owner = np.full(len(one), key[0].as_py(), np.int32)
            out = pa.concat_tables([out, pa.table([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(owner), pa.array(found.known[least])], schema=asking)])
        del found
        worker.trim()
        return out

    def covered(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        found = _Unit(left, doc_id, text, width, bits)
        return found.covered(_unsigned(right.column("one")), _unsigned(right.column("two"))), found.bounds

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        worker.start()
        gone, bounds = covered(left, right)
        worker.trim()
        fresh_start = gone.copy()
        fresh_start[1:] &= ~gone[:-1]
        inner = bounds[1:-1][bounds[1:-1] < len(gone)]
        fresh_start[inner] = gone[inner]
        stop = gone.copy()
        stop[:-1] &= ~gone[1:]
        back = inner[inner > 0] - 1
        stop[back] = gone[back]
        firsts, lasts = np.flatnonzero(fresh_start), np.flatnonzero(stop) + 1
        home = np.searchsorted(bounds, firsts, side="right") - 1
        total = np.zeros(len(gone) + 1, np.int32)
        np.cumsum(gone, out=total[1:])
        n_removed = (total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64)
        kept, rows = [], 0
        keep = ~gone
        for part in left.column(text).chunks:  # so that few kept texts are held twice
            texts = []
            for k, value in enumerate(part, rows):
                words = (value.as_buffer().to_pybytes() if value.is_valid else b"").split()
                texts.append(b" ".join(words if not n_removed[k] else compress(words, keep[bounds[k] : bounds[k + 1]].tolist())))
            rows += len(part)
            kept.append(pa.array(texts, pa.binary()).cast(pa.string()))
        offsets = np.searchsorted(home, np.arange(left.num_rows + 1)).astype(np.int32)
        base = bounds[home]
        spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(firsts - base), pa.array(lasts - base)], names=["first", "last"])).cast(to_arrow_type(SPANS))
        return pa.table([*[left.column(c) for c in names], pa.array(np.diff(bounds)), pa.array(n_removed), spans, pa.chunked_array(kept, pa.string())], names=[*names, *added])

    asking = pa.schema([("one", pa.int64()), ("two", pa.int64()), (unit, pa.int32()), ("least", pa.int64())])
    sent = spread.groupBy(unit).applyInArrow(announce, f"anchor long, `{unit}` int").repartition(parts, "anchor")
    shared = sent.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1").select("anchor", unit)
    asked = spread.groupBy(unit).cogroup(shared.groupBy(unit)).applyInArrow(ask, f"one long, two long, `{unit}` int, least long").repartition(parts, "one", "two")
    smaller = asked.withColumn("m", F.min("least").over(Window.partitionBy("one", "two"))).where("m < least").select("one", "two", unit)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(added, (T.LongType(), T.LongType(), SPANS, T.StringType()), strict=True)]])
    return spread.groupBy(unit).cogroup(smaller.groupBy(unit)).applyInArrow(apply, schema)
