"""Quality classifier from weak labels.

Heuristic labellers vote bad (-1), good (1) or not at all (0) on every document;
those that look for one kind of junk never vote good, as its absence says little.
Their votes are counted in Spark as patterns (3**8 at most, whatever the
corpus), and expectation-maximisation over the pattern counts estimates how
often each labeller votes what for good and for bad documents. The posterior of
a document's pattern is its soft label, and a logistic regression on hashed
shapes of words and word pairs is fitted to the soft labels of ``SAMPLE``
documents at most, those with the smallest hash of the id (of repeated ids, one
row; rows without an id are not fitted to). Every document is scored by that model, from its whole text; those under ``THRESHOLD`` are
rejected. No true labels are used.

Edge cases: null and blank texts have no words, get score 0 and are rejected;
other documents of fewer than ``SHORT`` words have too little to judge by, and
only strong signs (their score) reject them; repeated rows score alike; an empty
table gives an empty one; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import linear, worker
from loomgraph.llm.columns import without
from loomgraph.llm.sample import one_text_each, smallest_hashes
from loomgraph.llm.textkernel import VALUES, VALUES_LOWER, Words, chunks, mix, window_owner
from loomgraph.session import prepare

SAMPLE = 20_000
THRESHOLD = 0.5
SHORT = 5
#: Added to the number of words, so that a few words don't decide alone.
STEADY = 8
#: Hash places of the scorer.
BITS = 14
ROUNDS = 100

LABELLERS = ("symbols", "capitals", "repeats", "separators", "function_words", "sentences", "word_lengths", "variety")

# Classes of bytes, as bits.
_LOWER, _UPPER, _DIGIT, _OTHER, _STOP, _MARK, _SYMBOL, _BANG = (1 << k for k in range(8))
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[128:] = _OTHER
for _chars, _bit in ((".?", _STOP), (",;:'\"()-", _MARK), ("#$%&*+/<=>@[\\]^_`{|}~", _SYMBOL), ("!", _BANG)):
    for _c in _chars:
        _CLASS[ord(_c)] = _bit

FUNCTION_WORDS = (
    "the of and to in is that it for on with as was are be this by at or from not have an but they which you were their had has "
    "de la le et les des en un du une que est pour qui dans par sur au avec ce il se pas plus sont "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat "
    "el los se del las por con para una su al lo como pero sus le ya este"
).split()


def _hash_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(Words(data, np.array([0, len(data)])).hashes(VALUES_LOWER))


_FUNCTION = _hash_of(FUNCTION_WORDS + [w + m for w in FUNCTION_WORDS for m in ".,"])


class _Measures:
    """What the labellers and the scorer look at, for the documents of a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        found = Words(data, offsets)
        self.n = np.diff(found.bounds)
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        kinds = _CLASS[data]
        self.kinds = np.bitwise_or.reduceat(kinds, found.starts) if len(found.starts) else np.zeros(0, np.uint8)
        size = found.ends - found.starts
        self.size = size
        raw, folded = found.hashes(VALUES), found.hashes(VALUES_LOWER)
        inner = np.ones(len(raw), bool)
        inner[found.bounds[:-1][self.n > 0]] = False
        self.same = np.zeros(len(raw), bool)
        self.same[1:] = (folded[1:] == folded[:-1]) & inner[1:]
        self.inner = inner
        at = np.searchsorted(_FUNCTION, folded)
        at[at == len(_FUNCTION)] = 0
        self.function = _FUNCTION[at] == folded
        some = np.maximum(self.n, 1)
        share = lambda flag: np.bincount(self.owner, weights=flag, minlength=len(self.n)) / some
        k = self.kinds
        self.symbols = share((k & _SYMBOL > 0) & (size > 1))
        self.separators = share((k & (_LOWER | _UPPER | _DIGIT | _OTHER)) == 0)
        self.capitals = share((k & _UPPER > 0) & (k & _LOWER == 0) & (size > 1) | (k & _BANG > 0))
        self.repeats = share(self.same)
        self.functions = share(self.function)
        self.stops = share(k & _STOP > 0)
        self.lengths = np.bincount(self.owner, weights=size, minlength=len(self.n)) / some
        order = np.lexsort((folded, self.owner))
        new = np.ones(len(order), bool)
        new[1:] = (folded[order[1:]] != folded[order[:-1]]) | (self.owner[order[1:]] != self.owner[order[:-1]])
        self.variety = np.bincount(self.owner[order][new], minlength=len(self.n)) / np.sqrt(2 * some)  # corrected type-token ratio

    def votes(self) -> np.ndarray:
        """One column for each labeller."""
        n, long = self.n, self.n >= 20

        def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
            return np.where((n == 0) | bad, -1, np.where(good, 1, 0))

        never = np.zeros(len(n), bool)
        return np.stack(
            [
                vote(self.symbols > 0.15, never),
                vote(self.capitals > 0.25, never),
                vote(self.repeats > 0.2, never),
                vote(self.separators > 0.15, never),
                vote(long & (self.functions < 0.06), self.functions > 0.15),
                vote(long & (self.stops < 0.02), self.stops > 0.04),
                vote((n > 2) & ((self.lengths > 14) | (self.lengths < 2)), never),
                vote(long & (self.variety < 1.2), never),
            ],
            axis=1,
        ).astype(np.int64)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(owners, hash places): the shape of each word, with what precedes it, and whether it repeats."""
        shape = (self.kinds.astype(np.uint64) << np.uint64(8)) | (np.minimum(self.size, 15) // 3).astype(np.uint64) << np.uint64(2) | (self.function.astype(np.uint64) << np.uint64(1)) | self.same.astype(np.uint64)
        pair = np.zeros(len(shape), np.uint64)
        pair[1:] = np.where(self.inner[1:], shape[:-1] + np.uint64(1), 0)
        both = np.concatenate([mix(shape + np.uint64(1 << 40)), mix(shape * np.uint64(1 << 20) + pair + np.uint64(1 << 50))])
        return np.concatenate([self.owner, self.owner]), (both >> np.uint64(64 - BITS)).astype(np.int64)


def _measured(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, _Measures]]:
    for first, last, data, offsets in chunks(batch.column(column)):
        yield first, last, _Measures(data, offsets)


_POWERS = 3 ** np.arange(len(LABELLERS))


def vote_patterns(docs: DataFrame, text: str) -> DataFrame:
    """(pattern, n): how many documents have each combination of votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start()
        counts = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, m in _measured(batch, "text"):
                counts += np.bincount((m.votes() + 1) @ _POWERS, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["pattern", "n"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, vote probabilities [class, labeller, vote + 1], share of good documents).

    It begins from labellers that are mostly right; pseudo-counts keep classes
    from changing places and votes that never occur from deciding.
    """
    both = (votes > 0).any(axis=0)[:, None]  # labellers that vote good, too
    prior = np.stack([np.where(both, [0.4, 0.3, 0.3], [0.29, 0.70, 0.01]), np.where(both, [0.02, 0.18, 0.8], [0.005, 0.99, 0.005])])  # bad documents, good documents
    strength = 0.05 * counts.sum()
    theta, good = prior.copy(), 0.8
    hot = np.eye(3)[votes + 1]
    post = np.full(len(votes), good)
    for _ in range(rounds):
        bad_side, good_side = (np.einsum("pkv,kv->p", hot, np.log(theta[c])) for c in (0, 1))
        post = linear.sigmoid(np.log(good / (1 - good)) + good_side - bad_side)
        for c, share in ((0, 1 - post), (1, post)):
            seen = np.einsum("p,pkv->kv", share * counts, hot) + strength * prior[c]
            theta[c] = seen / seen.sum(axis=1, keepdims=True)
        good = float(np.clip((post @ counts + 16) / (counts.sum() + 20), 0.01, 0.99))
    return post, theta, good


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    #: For each labeller, the chance of (bad, no, good) vote on bad and on good documents.
    accuracies: dict[str, tuple[list[float], list[float]]]
    share_good: float

    def scores(self, m: _Measures) -> np.ndarray:
        owner, place = m.features()
        sums = np.bincount(owner, weights=self.weight[place], minlength=len(m.n))
        return np.where(m.n > 0, linear.sigmoid(self.bias + sums / (m.n + STEADY)), 0.0)


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Labeller accuracies from all documents, and a scorer fitted to the soft labels of a bounded sample."""
    spark = prepare(docs.sparkSession)
    # 3**8 patterns at most.
    patterns = sorted((r["pattern"], r["n"]) for r in vote_patterns(docs, text).collect())
    if not patterns:
        return Model(np.zeros(1 << BITS), 0.0, {}, 1.0)
    number, counts = (np.array(x, np.int64) for x in zip(*patterns, strict=True))
    votes = number[:, None] // _POWERS % 3 - 1
    post, theta, good = expectation_maximisation(votes, counts.astype(np.float64))
    soft = np.full(3 ** len(LABELLERS), good)
    soft[number] = post
    sent = spark.sparkContext.broadcast(soft)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start()
        for batch in batches:
            for first, last, m in _measured(batch, "text"):
                owner, place = m.features()
                both, times = np.unique(owner << BITS | place, return_counts=True)
                cut = np.searchsorted(both >> BITS, np.arange(len(m.n) + 1))
                label = sent.value[(m.votes() + 1) @ _POWERS]
                packed = [((both[a:b] & ((1 << BITS) - 1)).astype(np.uint16).tobytes(), (times[a:b] / (n + STEADY)).astype(np.float32).tobytes()) for a, b, n in zip(cut[:-1], cut[1:], m.n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[first:last], pa.array(label), pa.array([p for p, _ in packed], pa.binary()), pa.array([t for _, t in packed], pa.binary())], names=["id", "soft", "places", "shares"])

    known = F.col(f"`{doc_id}`")
    chosen = smallest_hashes(docs.select(known.cast("long").alias("id")), sample)
    # The sample's ids are no more than its bound, so that side may be broadcast.
    picked = one_text_each(docs.select(known.cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "id", "left_semi"))
    # At most SAMPLE rows of a few hundred distinct word shapes; in the order of ids, so that sums are the same however rows are laid out.
    found = sorted((r for r in picked.mapInArrow(rows, "id long, soft double, places binary, shares binary").collect() if r["places"]), key=lambda r: r["id"])
    if not found:
        return Model(np.zeros(1 << BITS), 0.0, {}, good)
    sizes = np.array([len(r["places"]) // 2 for r in found])
    places = np.frombuffer(b"".join(r["places"] for r in found), np.uint16)
    shares = np.frombuffer(b"".join(r["shares"] for r in found), np.float32)
    target = np.array([r["soft"] for r in found])
    del found
    w, b = linear.fit(sizes, places, shares, target, np.ones(len(target)), 1 << BITS, l2=1e-6, rate=0.3)
    return Model(w, b, {name: (theta[0, k].round(4).tolist(), theta[1, k].round(4).tolist()) for k, name in enumerate(LABELLERS)}, good)


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD, quality: str = "quality_score", accepted: str = "accepted") -> DataFrame:
    """Adds the probability that a document is good, and whether it is accepted."""
    docs = without(docs, [quality, accepted])
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(quality, T.DoubleType()), T.StructField(accepted, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start()
        for batch in batches:
            found, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, last, m in _measured(batch, text):
                found[first:last], words[first:last] = sent.value.scores(m), m.n
            good = (words > 0) & (found >= np.where(words < SHORT, threshold / 4, threshold))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(good)], names=[*batch.schema.names, quality, accepted])

    return docs.mapInArrow(run, schema)
