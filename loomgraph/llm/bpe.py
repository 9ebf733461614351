"""Byte-pair encoding by a deterministic automaton compiled from the merge list.

The automaton reads tokens. It begins with one state that loops on every byte;
each merge rule ``a b`` then adds one *gadget*: the state that ``a`` leads to is
copied without its arc ``b``, arcs labelled ``a`` go to the copy, and wherever
``a`` can be read an arc ``ab`` is added that leads where ``b`` led. After all
merges, exactly one path spells any byte string, and it is the string's BPE
tokenisation; decoding emits the labels of the arcs.

To read bytes, it is composed with the deterministic automaton of the tokens'
spellings (a table of states by bytes, whose state says which tokens end here).
Of those, exactly one continues the only path that spells what comes before it,
as the arc table tells, so a word is one transition a byte, forwards and without
a choice to take back, in time linear in its length; the path's labels are then
read off from its end.

Copies are persistent: a state is the chain of arcs that its gadgets cut, each
with the time of its rule, and an arc added later is found through the arc that
it grew from. Compiling is linear in the number of merges (50,000 merges take
about two seconds), where tables of all states times all tokens would take 2.5
billion cells. Arcs and rows of the byte table are made when first used and kept,
as are the ids of words, each up to a number: a worker's memory doesn't grow with
the text that it has read.

Edge cases: a null text encodes as an empty one (no ids, decoded ``""``); strings
of special tokens in a text become their ids, as the reference library has it;
texts of any length are encoded whole; repeated rows are encoded alike; other
columns are kept, and an input column named like an output is replaced.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomgraph.llm import worker
from loomgraph.llm.columns import without
from loomgraph.session import prepare

#: GPT-2's pre-tokenisation.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words whose ids a worker keeps (those of ``KEEP_BYTES`` at most, some 160 bytes each) where ``encode`` isn't told otherwise.
KEEP_WORDS = 800_000
KEEP_BYTES = 64
#: Arcs and rows that are kept; beyond this the tables start anew.
KEEP_ARCS = 1 << 18
KEEP_ROWS = 1 << 14
#: Rows of a batch that are encoded, and given back, at once.
STEP_ROWS = 250


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class MergeAutomaton:
    """Transitions and labels of the automaton.

    ``vocab`` maps a token's bytes to its id, ``merges`` lists pairs of bytes in
    order of priority, ``special`` maps strings to ids outside the merges.
    """

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.special = dict(special or {})
        never = len(merges)
        self._born: dict[int, int] = {}
        self._left: dict[int, int] = {}
        self._right: dict[int, int] = {}
        self._cut: dict[tuple[int, int], int] = {}
        alphabet = {vocab[bytes([b])] for b in range(256) if bytes([b]) in vocab}
        live = set(alphabet)
        self._never = never
        self._arcs: dict[int, bool] = {}
        for time, (a, b) in enumerate(merges):
            left, right, both = vocab.get(a), vocab.get(b), vocab.get(a + b)
            if left not in live or right not in live or both is None:
                raise ValueError(f"merge {time} uses a token that is not there yet")
            if both not in live and self._reads(left, right):
                self._left[both], self._right[both], self._born[both] = left, right, time
                live.add(both)
            self._cut.setdefault((left, right), time)
        self._arcs.clear()
        size = max([*vocab.values(), *self.special.values()], default=-1) + 1
        labels = [b""] * size
        for token, i in vocab.items():
            labels[i] = token
        for text, i in self.special.items():
            labels[i] = text.encode()
        self.labels = labels
        self._lexicon({token: i for token, i in vocab.items() if i in live})
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._words = regex.compile(SPLIT)
        self._known = _Known(self)
        self._spelled = Labels(labels)

    @classmethod
    def from_json(cls, raw: str) -> MergeAutomaton:
        """From the text of a byte-level ``tokenizer.json``."""
        spec = json.loads(raw)
        model, chars = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser and added prefix space is compiled")
        raw_bytes = lambda s: bytes(chars[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that strip or ask for word bounds are not compiled")
        special = {t["content"]: t["id"] for t in added}
        vocab = {raw_bytes(k): v for k, v in model["vocab"].items() if k not in special}
        return cls(vocab, [(raw_bytes(a), raw_bytes(b)) for a, b in merges], special)

    def _reads(self, state: int, token: int) -> bool:
        """Whether the state that token ``state`` leads to has an arc ``token``."""
        key = state << 32 | token
        known = self._arcs.get(key)
        if known is None:
            known = self._has_arc(state, token)
            if len(self._arcs) >= KEEP_ARCS:
                self._arcs.clear()
            self._arcs[key] = known
        return known

    def _has_arc(self, state: int, token: int) -> bool:
        cut, left, right, born = self._cut, self._left, self._right, self._born
        grown = self._never  # the arc must not have been cut before the next one grew from it
        while True:
            owner, copied = state, self._never  # the cuts of this owner that came before the copy was taken
            while True:
                time = cut.get((owner, token))
                if time is not None and time < copied and time <= grown:
                    return False
                if owner not in right:
                    break
                copied = born[owner]
                owner = right[owner]
            if token not in left:
                return True
            grown = born[token]
            token = left[token]

    def _lexicon(self, spelled: dict[bytes, int]) -> None:
        """The automaton of spellings: state 0 has read nothing of a token, others the longest beginning of one that ends here."""
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for token, i in spelled.items():
            state = 0
            for byte in token:
                step = children[state]
                if byte not in step:
                    step[byte] = len(children)
                    children.append({})
                    own.append(-1)
                state = step[byte]
            own[state] = i
        fail, order = [0] * len(children), [0]
        for state in order:
            for byte, child in children[state].items():
                order.append(child)
                if state:
                    back = fail[state]
                    while back and byte not in children[back]:
                        back = fail[back]
                    fail[child] = children[back].get(byte, 0)
        self._fail = array("i", fail)
        #: Tokens that end in a state, longest first, as (length, id).
        self._ends: list[tuple[tuple[int, int], ...]] = [()] * len(children)
        size = [0] * len(children)
        for state in order:
            for child in children[state].values():
                size[child] = size[state] + 1
            if state:
                self._ends[state] = (((size[state], own[state]),) if own[state] >= 0 else ()) + self._ends[fail[state]]
        #: Children of a state: those from its place in ``_first`` to the next one.
        self._first = array("i", [0, *accumulate(map(len, children))])
        self._bytes = array("B", [byte for step in children for byte in step])
        self._child = array("i", [child for step in children for child in step.values()])
        self._rows: list[array | None] = [None] * len(children)
        self._n_rows = 0

    def _row(self, state: int) -> array:
        """A state's transitions by byte."""
        if self._n_rows >= KEEP_ROWS:
            self._rows[:] = [None] * len(self._rows)
            self._n_rows = 0
        todo = [state]
        while todo:
            at = todo[-1]
            if self._rows[at] is None and at and self._rows[self._fail[at]] is None:
                todo.append(self._fail[at])
                continue
            if self._rows[at] is None:
                row = array("i", self._rows[self._fail[at]] if at else [0] * 256)
                for k in range(self._first[at], self._first[at + 1]):
                    row[self._bytes[k]] = self._child[k]
                self._rows[at] = row
                self._n_rows += 1
            todo.pop()
        return self._rows[state]

    def word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word: the labels of the only path that spells it."""
        rows, ends, arc, reads = self._rows, self._ends, self._arcs.get, self._reads
        n, state = len(word), 0
        # By place, the last token of the path up to there; -1 where none ends. The place before the word has none, either.
        last = [-1] * (n + 1) if n < 1 << 16 else array("i", b"\xff" * (4 * (n + 1)))
        for at, byte in enumerate(word, 1):
            row = rows[state]
            state = row[byte] if row is not None else self._row(state)[byte]
            for size, token in ends[state]:
                if size == at:
                    last[at] = token
                    break
                before = last[at - size]
                if before >= 0:
                    allowed = arc(before << 32 | token)
                    if allowed if allowed is not None else reads(before, token):
                        last[at] = token
                        break
        out, at, labels = [], n, self.labels
        while at:
            token = last[at]
            if token < 0:
                raise ValueError("the vocabulary cannot spell this word")
            out.append(token)
            at -= len(labels[token])
        out.reverse()
        return out

    def keep(self, words: int) -> None:
        """Of how many words the ids are kept from now on."""
        if words < self._known.most:
            self._known.clear()
            self._known.aside.clear()
        self._known.most = words

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, np.int32)
        known = self._known
        if self._split is None or not any(s in text for s in self.special):
            return np.frombuffer(b"".join(map(known.__getitem__, self._words.findall(text))), np.int32)
        parts: list[bytes] = []
        for k, piece in enumerate(self._split.split(text)):
            if k % 2:
                parts.append(np.int32(self.special[piece]).tobytes())
            else:
                parts.extend(map(known.__getitem__, self._words.findall(piece)))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, in order."""
        return self._spelled.emit(ids)


class _Known(dict):
    """Ids of words as raw bytes, walked when first asked for.

    Once there are half of ``most`` they are put aside, for those that were put aside before;
    a word that is asked for again comes back, so that common words stay while rare ones go.
    """

    def __init__(self, automaton: MergeAutomaton):
        self._walk = automaton.word
        self.most = KEEP_WORDS
        self.aside: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.aside.get(word)
        if ids is None:
            spelled = word.encode()
            ids = array("i", self._walk(spelled)).tobytes()
            if len(spelled) > KEEP_BYTES:
                return ids
        if len(self) >= self.most // 2:
            self.aside = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Labels:
    """Byte strings by id, written one after another by gathers."""

    STEP = 1 << 17

    def __init__(self, labels: list[bytes]):
        self._size = np.array([len(x) for x in labels], np.int64)
        self._start = np.cumsum(self._size) - self._size
        self._bytes = np.frombuffer(b"".join(labels), np.uint8)

    def emit(self, ids: np.ndarray) -> bytes:
        parts = []
        for i in range(0, len(ids), self.STEP):
            part = ids[i : i + self.STEP]
            size = self._size[part]
            ends = np.cumsum(size)
            at = np.repeat(self._start[part] - (ends - size), size)
            at += np.arange(len(at))
            parts.append(self._bytes[at].tobytes())
        return b"".join(parts)


_COMPILED: dict[str, MergeAutomaton] = worker.kept()


def compiled(raw: str) -> MergeAutomaton:
    """The automaton of a tokenizer file's text; each worker compiles it once."""
    key = hashlib.md5(raw.encode()).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = MergeAutomaton.from_json(raw)
        worker.trim()
    return _COMPILED[key]


def load(spark: SparkSession, path: str) -> Any:
    """A broadcast of a tokenizer file. Its size is that of a vocabulary, not of the data; 64 MB at most."""
    with open(path, encoding="utf-8") as f:
        raw = f.read((64 << 20) + 1)
    if len(raw) > 64 << 20:
        raise ValueError("tokenizer file is larger than 64 MB")
    return spark.sparkContext.broadcast(raw)


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None, keep_words: int | None = None) -> DataFrame:
    """Adds the ids of every whole text, how many they are and, if named, the text decoded from them.

    ``keep_words``: of how many words a worker keeps the ids (``KEEP_WORDS``); fewer take less memory and more time.
    """
    new = [ids, n_tokens, *([decoded] if decoded else [])]
    docs = without(docs, new)
    spark = prepare(docs.sparkSession)
    tokenizer = load(spark, path)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(n_tokens, T.LongType(), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start(_COMPILED)
        automaton = compiled(tokenizer.value)
        automaton.keep(keep_words or KEEP_WORDS)
        for batch in (b.slice(k, STEP_ROWS) for b in batches for k in range(0, b.num_rows, STEP_ROWS)):
            found = [automaton.encode(x) for x in batch.column(text).to_pylist()]
            sizes = np.array([len(x) for x in found], np.int64)
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            arrays = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes)]
            if decoded:
                arrays.append(pa.array([automaton.decode(x).decode("utf-8", "replace") for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that ids spell; null ids give an empty text."""
    df = without(df, [text])
    spark = prepare(df.sparkSession)
    tokenizer = load(spark, path)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start(_COMPILED)
        automaton = compiled(tokenizer.value)
        for batch in batches:
            out = [automaton.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)
