import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import bpe


@pytest.fixture(scope="module")
def pair(tokenizer_path):
    with open(tokenizer_path, encoding="utf-8") as f:
        return bpe.MergeAutomaton.from_json(f.read()), Tokenizer.from_file(tokenizer_path)


def test_gadgets_on_a_small_vocabulary():
    """Overlapping merges of one letter: the case in which a copied state must lose its own arc."""
    vocab = {b"a": 0, b"b": 1, b"aa": 2, b"aaaa": 3, b"ab": 4, b"aab": 5}
    merges = [(b"a", b"a"), (b"aa", b"aa"), (b"a", b"b"), (b"aa", b"b")]
    automaton = bpe.MergeAutomaton(vocab, merges)

    def by_merging(word):
        parts = [bytes([c]) for c in word]
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == a and parts[i + 1] == b:
                    parts[i : i + 2] = [a + b]
                i += 1
        return [vocab[p] for p in parts]

    rnd = random.Random(1)
    for _ in range(3000):
        word = bytes(rnd.choice(b"aaab") for _ in range(rnd.randrange(1, 14)))
        assert automaton.word(word) == by_merging(word), word


def test_same_as_the_library(pair):
    automaton, library = pair
    rnd, vocab = random.Random(2), list(pair[1].get_vocab())
    chars = bpe.byte_alphabet()
    for k in range(1500):
        if k % 4 == 0:
            s = "".join(chr(rnd.choice([rnd.randrange(1, 127), rnd.randrange(0, 0x300), rnd.randrange(0x3000, 0x3100), rnd.randrange(0x10000, 0x1F700)])) for _ in range(40))
        elif k % 4 == 1:
            s = "".join(rnd.choice(" \t\n\r\x0b\x0c\x1c\x85\xa0 　a1.'sS") for _ in range(30))
        elif k % 4 == 2:
            s = "".join(bytes(chars.get(c, 32) for c in rnd.choice(vocab)).decode("utf-8", "ignore") for _ in range(12))
        else:
            s = rnd.choice(["a", "ab", "the", " ", "=", "é"]) * rnd.randrange(1, 60) + rnd.choice(["", "<|endoftext|>", "<|endoftext"]) + "x"
        ids = library.encode(s, add_special_tokens=False).ids
        assert list(automaton.encode(s)) == ids, s
        assert automaton.decode(np.array(ids)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_edges(edge_docs, no_docs, tokenizer_path, pair):
    rows = bpe.encode(edge_docs, tokenizer_path, decoded="decoded").select("doc_id", "text", "ids", "n_tokens", "decoded").collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert r["decoded"] == (r["text"] or "")
        assert len(r["ids"]) == r["n_tokens"]
        if len(r["text"] or "") < 10_000:
            assert r["ids"] == pair[1].encode(r["text"] or "", add_special_tokens=False).ids
    assert bpe.encode(no_docs, tokenizer_path).count() == 0
    again = bpe.decode(bpe.encode(edge_docs.where("doc_id < 8"), tokenizer_path), tokenizer_path)
    assert all(r["decoded"] == (r["text"] or "") for r in again.collect())


def test_one_long_word(pair):
    """Letters without a break are walked once, whatever their number, and ids agree with the library's."""
    automaton, library = pair
    rnd = random.Random(3)
    for letters in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "aab", "a", "éß漢"):
        word = "".join(rnd.choices(letters, k=50_000))
        assert list(automaton.encode(word)) == library.encode(word, add_special_tokens=False).ids
    long = "".join(rnd.choices("abcdefghij", k=1_000_000))
    assert automaton.decode(automaton.encode(long)).decode() == long
    assert max(map(len, automaton._known)) <= bpe.KEEP_BYTES


def test_tables_stay_bounded(pair, tokenizer_path, monkeypatch):
    """However many words a worker has read, it keeps a stated number of words, arcs and rows; ids stay right as they go."""
    for name, most in (("KEEP_WORDS", 200), ("KEEP_ARCS", 300), ("KEEP_ROWS", 100)):
        monkeypatch.setattr(bpe, name, most, raising=False)
    with open(tokenizer_path, encoding="utf-8") as f:
        automaton = bpe.MergeAutomaton.from_json(f.read())
    rnd = random.Random(4)
    for _ in range(60):
        text = "the same again " + " ".join("".join(rnd.choices("abcdeßé漢0", k=rnd.randrange(1, 9))) for _ in range(50))
        assert list(automaton.encode(text)) == pair[1].encode(text, add_special_tokens=False).ids
        assert len(automaton._known) + len(automaton._known.aside) <= 200
        assert len(automaton._arcs) <= 300
        assert sum(row is not None for row in automaton._rows) <= 100 + 64  # with those that one row is grown from
        assert " same" in automaton._known or " same" in automaton._known.aside


def test_a_batch_is_given_back_in_steps(spark, tokenizer_path, pair, monkeypatch):
    """A worker doesn't hold a whole batch with all its ids: it gives rows back a step at a time, each once and in order."""
    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "concat('w ', id) AS text")
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    given = list(bpe.encode(docs, tokenizer_path)(iter([batch])))
    assert max(b.num_rows for b in given) <= 250
    rows = [r for b in given for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [*range(2000)]
    assert all(r["ids"] == pair[0].encode(r["text"]).tolist() and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_a_worker_starts_trimmed(monkeypatch):
    """What one task has left free is given back before the next, but not while an operator's own tables are in use."""
    trimmed, mine = [], bpe.worker.kept()
    bpe.worker.start()
    monkeypatch.setattr(bpe.worker, "trim", lambda: trimmed.append(1))
    bpe.worker.start()
    assert trimmed == [1]
    mine["table"] = 1
    bpe.worker.start(mine)
    assert trimmed == [1] and mine
    bpe.worker.start()
    assert trimmed == [1, 1] and not mine
    bpe.worker._KEPT.pop()
