import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import toxicity

BAD = ["grubbler", "snivelwit", "dolthead"]


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "in", "ea", "st", "nd"]) for _ in range(rnd.randrange(1, 4)))
    docs, labels = [], []
    for i in range(500):
        ws = [word() for _ in range(rnd.randrange(5, 200))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                ws[rnd.randrange(len(ws))] = rnd.choice(BAD)
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return d, labels, toxicity.fit(d.where("doc_id < 400"), spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int").where("doc_id < 400"))


def test_held_out_accuracy(model):
    docs, labels, fitted = model
    marks = dict(labels)
    rows = toxicity.score(docs.where("doc_id >= 400"), fitted).collect()
    right = sum(r["predicted"] == marks[r["doc_id"]] for r in rows)
    assert right / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_grams_are_those_of_the_text(monkeypatch):
    rnd = random.Random(13)
    texts = ["abcd", None, "", "xyzabc", "é漢 " * 9, "a" * 50] + ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(0, 400))) for _ in range(30)]

    def counts():
        return {(first + int(o), int(p)): int(n) for first, owner, place, times in toxicity.gram_counts(texts) for o, p, n in zip(owner, place, times, strict=True)}

    whole = counts()
    for k, t in enumerate(texts):
        padded = f" {t} " if t else ""
        grams = {padded[i : i + q] for q in toxicity.ORDERS for i in range(len(padded) - q + 1)}
        total = sum(max(len(padded) - q + 1, 0) for q in toxicity.ORDERS)
        assert sum(n for (o, _), n in whole.items() if o == k) == total
        assert sum(o == k for o, _ in whole) == len(grams)
    monkeypatch.setattr(toxicity, "STEP", 37)  # long texts in parts give the same counts
    assert counts() == whole


def test_edges(edge_docs, no_docs, model, spark):
    fitted = model[2]
    rows = toxicity.score(edge_docs, fitted).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert toxicity.score(no_docs, fitted).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(edge_docs, toxicity.fit(edge_docs, nothing)).where("score = 0.5").count() == len(rows)
    one_sided = spark.createDataFrame([(5, 0), (6, 0)], "doc_id long, toxic int")
    assert toxicity.score(edge_docs, toxicity.fit(edge_docs, one_sided)).where("predicted = 1").count() == 0


def test_ratios_and_fit_against_counting(spark):
    """Kept features, log-count ratios and the fitted scores, computed once more from dictionaries of grams."""
    rnd = random.Random(17)
    docs = [(i, " ".join(rnd.choice(["calm", "words", "here", "lamp", "door", *(BAD if i % 4 == 0 else [])]) for _ in range(rnd.randrange(4, 20)))) for i in range(160)]
    labels = [(i, int(i % 4 == 0)) for i, _ in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    fitted = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    place_of = lambda gram: int(toxicity._places([gram])[1][-1])
    seen, features = {}, {}
    for i, t in docs:
        padded, times = f" {t.lower()} ", {}
        for q in toxicity.ORDERS:
            for k in range(len(padded) - q + 1):
                gram = padded[k : k + q]
                times[gram] = times.get(gram, 0) + 1
        by_place = {}
        for gram, n in times.items():
            p = seen.setdefault(gram, place_of(gram))
            by_place[p] = by_place.get(p, 0) + n
        features[i] = {(level, p) for p, n in by_place.items() for level in range(toxicity.LEVELS) if n > level}
    rows, marks = [sum(1 for _, y in labels if y == k) for k in (0, 1)], dict(labels)
    counts = {}
    for i, fs in features.items():
        for f in fs:
            counts.setdefault(f, [0, 0])[marks[i]] += 1
    total = [sum(c[k] for c in counts.values()) + toxicity.SMOOTHING * toxicity.LEVELS * (1 << toxicity.BITS) for k in (0, 1)]
    ratio = {f: math.log((c[1] + 1) / total[1]) - math.log((c[0] + 1) / total[0]) for f, c in counts.items()}

    def gain(c):
        n, have, out = sum(rows), sum(c), 0.0
        for k in (0, 1):
            for x, whole in ((c[k], have), (rows[k] - c[k], n - have)):
                out += x * math.log(x / (whole * rows[k] / n)) if x else 0.0
        return out

    kept = {f for f, c in counts.items() if sum(c) >= 3 and gain(c) >= toxicity.LEAST_GAIN}
    mine = {(int(level), int(p)): int(fitted.slot[level, p]) for level, p in zip(*np.nonzero(fitted.slot), strict=True)}
    assert set(mine) == kept and len(kept) > 50
    assert all(abs(fitted.ratio[n] - ratio[f]) < 1e-4 for f, n in mine.items())
    for i, t in docs[:40]:
        score = fitted.bias + sum(fitted.weight[mine[f]] for f in features[i] & kept)
        assert abs(fitted.scores([t])[0] - 1 / (1 + math.exp(-score))) < 1e-6
    # The weights are where the penalised loss is flat.
    x = np.array([[ratio[f] if f in features[i] else 0.0 for f in sorted(mine, key=mine.get)] for i, _ in docs])
    y = np.array([marks[i] for i, _ in docs], float)
    w = fitted.weight[1:] / fitted.ratio[1:]
    share = y.mean()
    c = np.where(y == 1, np.sqrt((1 - share) / share), 1.0)
    slope = x.T @ (c * (1 / (1 + np.exp(-(x @ w + fitted.bias))) - y)) / c.sum() + 1e-3 * w
    assert np.abs(slope).max() < 0.02


def test_layout_of_rows_changes_no_score(spark, edge_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one, many = (toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (2, 11))
    assert one.bias == many.bias and (one.weight == many.weight).all() and (one.slot == many.slot).all()


def test_sample_is_the_smallest_hashes(spark, monkeypatch):
    from loomgraph.llm import sample

    ids = spark.range(5000).union(spark.range(100)).selectExpr("id").union(spark.sql("SELECT CAST(NULL AS long)"))
    want = {r["id"] for r in spark.range(5000).orderBy(F.xxhash64("id")).limit(300).collect()}
    for few in (10, 10**6):
        monkeypatch.setattr(sample, "FEW", few)
        assert {r["id"] for r in sample.smallest_hashes(ids, 300).collect()} == want
    assert sample.smallest_hashes(ids.where("id < 5"), 300).count() == 5
