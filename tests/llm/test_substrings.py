import random
import re

from loomgraph.llm import substrings


def brute(rows, width):
    """(kept, removed) per row, windows judged on the input."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    least = {}
    for i, ws in words:
        for k in range(len(ws) - width + 1):
            key = tuple(ws[k : k + width])
            least[key] = min(least.get(key, float("inf")), order(i))
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - width + 1):
            if least[tuple(ws[k : k + width])] < order(i):
                gone.update(range(k, k + width))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    passage = [[rnd.choice("abc") + str(rnd.randrange(40)) for _ in range(rnd.randrange(4, 30))] for _ in range(12)]
    rows = []
    for i in range(150):
        ws = []
        for _ in range(rnd.randrange(0, 5)):
            ws += rnd.choice(passage) if rnd.random() < 0.6 else [rnd.choice("xyz") + str(rnd.randrange(30)) for _ in range(rnd.randrange(1, 20))]
        rows.append((i * 7 % 150, rnd.choice([" ", "\n", "  \t"]).join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (1, 3, 8):
        found = substrings.remove_repeats(df, width=width, unit_bytes=200)
        assert result(found) == brute(rows, width)


def test_intervals_are_maximal_and_agree(spark):
    rows = [(1, "a b c d e f g h"), (2, "x a b c d y e f g h z"), (3, "q b c d e f g")]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=3)
    spans = {r["doc_id"]: [(s["first"], s["last"]) for s in r["removed"]] for r in found.collect()}
    assert spans == {1: [], 2: [(1, 5), (6, 10)], 3: [(1, 7)]}


def test_edges(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert result(substrings.remove_repeats(edge_docs, width=50)) == brute(rows, 50)
    assert substrings.remove_repeats(no_docs).count() == 0


def test_first_hashes_that_collide(spark):
    """With 6 bits of the first hash nearly all windows share it with others, and the second one tells them apart."""
    rnd = random.Random(4)
    shared = [rnd.choice("abcd") + str(rnd.randrange(60)) for _ in range(40)]
    rows = [(i, " ".join([rnd.choice("uvw") + str(rnd.randrange(99)) for _ in range(rnd.randrange(30))] + shared[rnd.randrange(20) :])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (6, 64):
        assert result(substrings.remove_repeats(df, width=4, unit_bytes=500, bits=bits)) == brute(rows, 4)


def test_rows_without_id_or_of_one_id_spread(spark):
    rnd = random.Random(5)
    text = lambda: " ".join(rnd.choice("abcdef") for _ in range(60))
    rows = [(rnd.choice([None, 7, 7, i]), text()) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substrings.remove_repeats(df, width=5, unit_bytes=500)) == brute(rows, 5)


def test_layout():
    """Units follow the text; partitions stay a bounded number of bytes, so 100 TB is some 100,000 of them."""
    assert substrings.layout(0, 16 << 20) == (4, 4)
    assert substrings.layout(1 << 30, 16 << 20) == (64, 64)
    units, parts = substrings.layout(100 << 40, 16 << 20)
    assert units == 100 << 16 and parts == 100 << 10


def test_memory_of_a_unit():
    """A worker holds 24 bytes for each window and the temporaries of one slice, not several copies of all windows."""
    import os
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa
from loomgraph.llm import substrings as S
most = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
words = np.random.default_rng(1).integers(0, 1 << 30, 2_000_000).astype("S10").reshape(-1, 1000)
texts = [b" ".join(row).decode() for row in words]
table = pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
few = table.slice(0, 20)
S._Unit(few, "doc_id", "text", 50, 64).covered(S._NONE, S._NONE)
before = most()
S._Unit(table, "doc_id", "text", 50, 64).covered(S._NONE, S._NONE)
print(most() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    assert float(out.stdout) < 120


def test_slices_give_the_same_groups(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(6)
    rows = [(rnd.choice([None, *range(9)]), " ".join(rnd.choice("abc") for _ in range(rnd.randrange(40)))) for _ in range(60)]
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])})
    want = None
    for size, bits in ((1 << 18, 64), (1 << 18, 3), (7, 64), (7, 3), (1, 2)):
        monkeypatch.setattr(substrings, "SLICE", size)
        unit = substrings._Unit(table, "doc_id", "text", 4, bits)
        found = {(int(b), tuple(sorted(at[group == k].tolist())), int(unit.known[least[k]])) for at, group, _, two, least in unit.groups() for k, b in enumerate(two)}
        want = want or found
        assert found == want and sum(len(at) for _, at, _ in found) == len(unit.one)
        some = sorted({b for b, _, _ in found})[::3]
        pairs = [(o, t) for o, t in zip(unit.one.tolist(), unit.two.tolist()) if t in some]
        gone = unit.covered(np.array([o for o, _ in pairs], np.uint64), np.array([t for _, t in pairs], np.uint64))
        starts = [unit.starts[w] for b, at, least in found for w in at if b in some or unit.known[unit.rank[w]] > least]
        marked = np.zeros(unit.words, bool)
        for s in starts:
            marked[s : s + 4] = True
        assert gone.tolist() == marked.tolist()


def test_tables_of_other_operators_are_dropped():
    from loomgraph.llm import bpe, worker

    other = worker.kept()
    other["x"], bpe._COMPILED["y"] = 1, None
    worker.start(bpe._COMPILED)
    assert not other and bpe._COMPILED
    worker.start()
    assert not bpe._COMPILED
    worker.trim()
