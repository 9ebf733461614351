"""Packing of token ids into rows of fixed length, by best-fit decreasing.

Texts become ids; those longer than a row are split, without loss, into pieces
of a whole row and a rest. Pieces are placed longest first, each into the bin
with the least room that still holds it, which a segment tree over capacities
finds in logarithmic time. A packed row is the ids of its pieces, padded, the
cumulative lengths of its segments, and positions that begin at 0 with each
segment.

Rows are packed within groups of ``GROUP_TOKENS`` tokens of one input partition,
so nothing is shuffled, a hot source does no harm, memory doesn't follow the
partition's size, and a lost task is simply run again. A group holds thousands
of rows, of which only the last few have room to spare. So which documents share
a row depends on how the input is split into partitions; what is in the rows
together does not.

Edge cases: null and empty texts have no tokens and appear in no row; a text of
any length is kept whole across pieces, in order; repeated rows are packed each;
a null id stays null in ``doc_ids``; an empty table gives no rows; other columns
are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import prepare

ROW_TOKENS = 2048
GROUP_TOKENS = 4_000_000
PAD = 50256

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class CapacityTree:
    """Bins by the room that is left in them, with the least sufficient room found in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(bin, its room) with the least room of ``size`` or more, taken out; None if there is none."""
        count, at = self.count, size + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not count[at]:
                    at += 1
        room = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return self.bins[room].pop(), room


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Numbers of the pieces in each bin. Pieces of one size keep their order."""
    tree, bins = CapacityTree(capacity), []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        got = tree.take(size)
        if got is None:
            number, room = len(bins), capacity
            bins.append([])
        else:
            number, room = got
        bins[number].append(piece)
        if room - size > 0:
            tree.add(room - size, number)
    return bins


#: A run of white space from here on is cut out as the pattern would cut it, since the pattern's look-ahead overflows its stack on some 900,000.
LONG_BLANKS = 100_000
_BLANKS = regex.compile(r"\p{White_Space}{%d,}" % LONG_BLANKS)


def encode_whole(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text with white space of any length. Of a long run, all but a last blank before a word is one piece."""
    if len(text) < LONG_BLANKS:
        return encoder.encode_ordinary(text)
    out, at = [], 0
    for run in _BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoder.encode_ordinary(text[at : run.start()])
        out += encoder._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoder.encode_ordinary(text[at:])


_ENCODERS: dict[bytes, tiktoken.Encoding] = {}


def _encoder(raw: bytes) -> tiktoken.Encoding:
    if raw not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _ENCODERS.clear()
        _ENCODERS[raw] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[raw]


def token_ids(path: str, spark) -> Callable[[], Callable[[str], list[int]]]:  # noqa: ANN001
    """A maker of encoders for workers; the vocabulary file (64 MB at most) is broadcast."""
    with open(path, "rb") as f:
        raw = f.read((64 << 20) + 1)
    if len(raw) > 64 << 20:
        raise ValueError("tokenizer file is larger than 64 MB")
    sent = spark.sparkContext.broadcast(raw)
    return lambda: partial(encode_whole, _encoder(sent.value))


SCHEMA = "shard int, bin long, n_tokens int, doc_ids array<long>, pieces array<int>, input_ids binary, cu_seqlens array<int>, position_ids binary"


def pack(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", row_tokens: int = ROW_TOKENS, group_tokens: int = GROUP_TOKENS, pad: int = PAD) -> DataFrame:
    """One row per packed row: its shard and number, documents and piece numbers of its segments, and

    ``input_ids`` (``row_tokens`` little-endian unsigned ids of 16 bits, or 32 if the padding id needs them),
    ``cu_seqlens`` (from 0 to ``n_tokens``) and ``position_ids`` (32 bits each; padding has 0).
    """
    spark = prepare(docs.sparkSession)
    make = token_ids(path, spark)
    kind = np.dtype("<u2" if pad < 1 << 16 else "<u4")

    def packed(shard: int, first: int, ids: list[np.ndarray], owners: list, parts: list[int]) -> pa.RecordBatch:
        bins = best_fit_decreasing(np.array([len(x) for x in ids]), row_tokens)
        columns: list[list] = [[] for _ in range(8)]
        for number, pieces in enumerate(bins):
            sizes = [len(ids[p]) for p in pieces]
            total = sum(sizes)
            row, position = np.full(row_tokens, pad, kind), np.zeros(row_tokens, "<u4")
            row[:total] = np.concatenate([ids[p] for p in pieces])
            position[:total] = np.concatenate([np.arange(s) for s in sizes])
            for column, value in zip(columns, (shard, first + number, total, [owners[p] for p in pieces], [parts[p] for p in pieces], row.tobytes(), np.cumsum([0, *sizes]).tolist(), position.tobytes()), strict=True):
                column.append(value)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.binary())
        names = ["shard", "bin", "n_tokens", "doc_ids", "pieces", "input_ids", "cu_seqlens", "position_ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, first = make(), TaskContext.get().partitionId(), 0
        ids, owners, parts, size = [], [], [], 0
        for batch in batches:
            for owner, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not value:
                    continue
                whole = np.array(encode(value), kind)
                for part, at in enumerate(range(0, len(whole), row_tokens)):
                    ids.append(whole[at : at + row_tokens])
                    owners.append(owner)
                    parts.append(part)
                size += len(whole)
                if size >= group_tokens:
                    out = packed(shard, first, ids, owners, parts)
                    first += out.num_rows
                    yield from (out.slice(k, 256) for k in range(0, out.num_rows, 256))
                    ids, owners, parts, size = [], [], [], 0
        if ids:
            out = packed(shard, first, ids, owners, parts)
            yield from (out.slice(k, 256) for k in range(0, out.num_rows, 256))

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet, one folder per shard; each row's binary columns are a matrix row as it stands."""
    packed.write.partitionBy("shard").mode("overwrite").parquet(path)


def matrices(rows: list, row_tokens: int = ROW_TOKENS, pad: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions) of packed rows, as matrices."""
    kind = "<u2" if pad < 1 << 16 else "<u4"
    ids = np.frombuffer(b"".join(bytes(r["input_ids"]) for r in rows), kind).reshape(-1, row_tokens)
    return ids, np.frombuffer(b"".join(bytes(r["position_ids"]) for r in rows), "<u4").reshape(-1, row_tokens)
