"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of 3 to 6 of a lower-cased text,
hashed; one that occurs two or three times is a feature more each. Of labelled
texts, counts of documents by feature and label give each feature's log-count
ratio; the features that say most about the label (largest
log-likelihood ratio) are kept, their presence is scaled by the ratio, and a
logistic regression is fitted to that. Scoring reads whole texts.

It is fitted to ``SAMPLE`` labelled rows at most, those with the smallest hash
of the id (of repeated ids, one row), so the model costs the same whatever the corpus; the ids of the
sample and the model are what is broadcast, and their size is bounded by
``SAMPLE`` and ``FEATURES``.

Edge cases: null texts count as empty, and an empty text has the score of the
bias; labels that are null are left out, and the larger counts where an id has
two; without both labels among the rows the score is the share of toxic ones
(0.5 without any rows); repeated rows score alike; an empty table gives an
empty one; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import linear
from loomgraph.llm.columns import without
from loomgraph.llm.sample import one_text_each, smallest_hashes
from loomgraph.session import prepare, scratch

ORDERS = (3, 4, 5, 6)
#: Labelled rows to fit to, at most; features to keep; hash places (a power of two).
SAMPLE = 20_000
FEATURES = 8_192
BITS = 20
#: An n-gram counts as present, as there twice, and as there three times.
LEVELS = 3
#: Log-likelihood ratio below which a feature may be chance, as there are millions to choose from.
LEAST_GAIN = 12.0
#: Added to the counts.
SMOOTHING = 1.0
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = 64
#: Characters handled at once.
STEP = 1 << 18


def _places(texts: list[str], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(owners, hash places) of the n-grams of texts; only of those that begin before ``most``, if given."""
    lengths = np.array([len(x) for x in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
    hashed = np.zeros(len(chars), np.uint64)
    owners, places = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for n in range(1, max(ORDERS) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        hashed = hashed[:m] * np.uint64(0xD6E8FEB86659FD93) + chars[n - 1 :]
        if n in ORDERS:
            whole = room[:m] >= n
            if most is not None:
                whole[most:] = False
            owners.append(owner[:m][whole])
            places.append((((hashed[whole] ^ (hashed[whole] >> np.uint64(29))) * _FACTOR) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(places)


def gram_counts(texts: list[str | None], wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, owners, hash places, times) of the n-grams of runs of whole texts, each (owner, place) once.

    A long text is counted in overlapping parts, so that memory doesn't follow its length.
    ``wanted`` marks the places to look at; without it all are.
    """

    def counted(part: list[str], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        owner, place = _places(part, most)
        if wanted is not None:
            some = np.flatnonzero(wanted[place])
            owner, place = owner[some], place[some]
        return np.unique(owner.astype(np.int64) << BITS | place, return_counts=True)

    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size < STEP):
            size += len(texts[last] or "")
            last += 1
        part = [f" {(x or '').lower()} " if x else "" for x in texts[first:last]]
        if len(part) == 1 and len(part[0]) > STEP:
            text, keys, times = part[0], np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(0, len(text), STEP):
                more, n = counted([text[at : at + STEP + max(ORDERS) - 1]], STEP)
                both, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
                keys, times = both, np.bincount(where.ravel(), weights=np.concatenate([times, n]), minlength=len(both)).astype(np.int64)
        else:
            keys, times = counted(part)
        yield first, keys >> BITS, keys & ((1 << BITS) - 1), times
        first = last


@dataclass
class Model:
    """``slot[level]`` gives each hash place its number among the kept features, or 0; ``weight[0]`` is 0."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float
    #: Log-count ratio by number; that of 0 is 0.
    ratio: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for first, owner, number in present(texts, self.slot):
            sums = np.bincount(owner, weights=self.weight[number])
            out[first : first + len(sums)] += sums
        return linear.sigmoid(out)


def present(texts: list[str | None], slot: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, owners, kept features that are present) of runs of whole texts."""
    wanted = slot.any(axis=0)
    for first, owner, place, times in gram_counts(texts, wanted):
        owners, numbers = [], []
        for level in range(LEVELS):
            enough = times > level
            number = slot[level][place[enough]]
            owners.append(owner[enough][number > 0])
            numbers.append(number[number > 0])
        yield first, np.concatenate(owners), np.concatenate(numbers).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """A model of the labelled rows (``labels``: id and label) of ``docs``."""
    spark = prepare(docs.sparkSession)
    named = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = named.join(F.broadcast(smallest_hashes(named, sample)), "id", "left_semi")
    at = scratch(spark, "toxicity")
    # The sample's ids are no more than its bound, so that side may be broadcast.
    wanted = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen.select("id")), "id", "left_semi")
    one_text_each(wanted).join(F.broadcast(chosen), "id").select("id", "text", "label").repartition(8).write.parquet(at)
    picked = spark.read.parquet(at)
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((2, LEVELS * size), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            marks = batch.column("label").to_numpy()
            rows += np.bincount(marks, minlength=2)[:2]
            for first, owner, place, times in gram_counts(batch.column("text").to_pylist()):
                mark = marks[first + owner]
                for k in (0, 1):
                    for level in range(LEVELS):
                        np.add.at(seen[k], place[(mark == k) & (times > level)] + level * size, 1)
        if rows.sum():
            each = LEVELS * size // _BLOCKS
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_BLOCKS), pa.int32()), pa.array([seen[:, k * each : (k + 1) * each].tobytes() for k in range(_BLOCKS)], pa.binary()), pa.array([rows.tobytes()] * _BLOCKS, pa.binary())], names=["block", "seen", "rows"]
            )

    def total(key: tuple, table: pa.Table) -> pa.Table:
        add = lambda name, kind: sum(np.frombuffer(x.as_buffer(), kind).astype(np.int64) for x in table.column(name))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([add("seen", np.int32).astype(np.int32).tobytes()], pa.binary()), pa.array([add("rows", np.int64).tobytes()], pa.binary())], names=["block", "seen", "rows"])

    kinds = "block int, seen binary, rows binary"
    # As many bytes as there are hash places, whatever the sample: 24 MB in 64 rows.
    blocks = sorted(picked.mapInArrow(count, kinds).groupBy("block").applyInArrow(total, kinds).collect(), key=lambda r: r["block"])
    nothing = np.zeros((LEVELS, size), np.uint16)
    rows = np.frombuffer(blocks[0]["rows"], np.int64) if blocks else np.zeros(2, np.int64)
    if not rows.all():
        share = (rows[1] + 0.5) / (rows.sum() + 1)
        return Model(nothing, np.zeros(1), float(np.log(share / (1 - share))), np.zeros(1))
    # How much each feature's presence says about the label: the log-likelihood ratio of its two-by-two
    # table. Block by block, so that the driver holds two numbers for each hash place.
    term = lambda x, y: x * np.log(np.maximum(x, 1e-12) / np.maximum(y, 1e-12))
    n, sums = rows.sum(), np.full(2, SMOOTHING * LEVELS * size)
    ratio, gain = np.empty(LEVELS * size, np.float32), np.empty(LEVELS * size, np.float32)
    at = 0
    for block in blocks:
        seen = np.frombuffer(block["seen"], np.int32).reshape(2, -1).astype(np.float64)
        sums += seen.sum(axis=1)
        to = at + seen.shape[1]
        ratio[at:to] = np.log(seen[1] + SMOOTHING) - np.log(seen[0] + SMOOTHING)
        have = seen.sum(axis=0)
        gain[at:to] = sum(term(seen[k], have * rows[k] / n) + term(rows[k] - seen[k], (n - have) * rows[k] / n) for k in (0, 1))
        gain[at:to][have < 3] = 0
        at = to
    del blocks
    ratio -= np.log(sums[1]) - np.log(sums[0])
    gain[gain < LEAST_GAIN] = 0
    some = np.flatnonzero(gain)
    best = np.sort(some[np.argsort(-gain[some], kind="stable")[:features]])
    slot = nothing.copy()
    slot.reshape(-1)[best] = np.arange(1, len(best) + 1)
    chart = spark.sparkContext.broadcast(slot)

    def rows_present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            packed = [b""] * len(texts)
            for first, owner, number in present(texts, chart.value):
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(int(owner.max(initial=-1)) + 2))
                for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    packed[first + k] = np.sort(number[order[i:j]]).astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(packed, pa.binary())], names=["id", "label", "present"])

    # At most SAMPLE rows of at most FEATURES two-byte numbers; a few hundred bytes each in practice.
    # They are put in the order of ids, so that sums are the same however rows are laid out.
    rows_of = sorted(picked.select("id", "text", "label").mapInArrow(rows_present, "id long, label int, present binary").collect(), key=lambda r: r["id"])
    sets = [np.frombuffer(r["present"], np.uint16).astype(np.int64) - 1 for r in rows_of]
    target = np.array([r["label"] for r in rows_of], np.float64)
    sizes, column = np.array([len(s) for s in sets]), np.concatenate(sets)
    scaled = ratio[best]
    share = target.mean()
    weight = np.where(target == 1, np.sqrt((1 - share) / share), 1.0)
    w, b = linear.fit(sizes, column, scaled[column], target, weight, len(best), l2=1e-3)
    return Model(slot, np.append(0.0, w * scaled), b, np.append(0.0, scaled))


def score(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds the probability that a text is toxic, and whether that is 0.5 or more (1 or 0)."""
    docs = without(docs, [score, predicted])
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.scores(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[*batch.schema.names, score, predicted])

    return docs.mapInArrow(run, schema)
