import re

import numpy as np
import pytest

from loomgraph.llm import quality

FUNCTION = {w + m for w in quality.FUNCTION_WORDS for m in ("", ".", ",")}


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(docs)
    return model, {r["doc_id"]: r["accepted"] for r in quality.score(docs, model).collect()}


def test_agrees_with_labels_it_never_saw(scored, spark):
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [scored[1][i] for i, q in marks.items() if q == 1]
    bad = [scored[1][i] for i, q in marks.items() if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_em_recovers_accuracies():
    """Votes drawn from known accuracies: estimates come near, and posteriors beat a majority vote's worst labeller."""
    rnd = np.random.default_rng(4)
    truth = rnd.random(20_000) < 0.7
    accuracy = [0.95, 0.9, 0.8, 0.75]
    votes = np.stack([np.where(rnd.random(len(truth)) < a, truth, ~truth) * 2 - 1 for a in accuracy], axis=1)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, theta, good = quality.expectation_maximisation(patterns, counts.astype(float))
    assert ((post[where.ravel()] > 0.5) == truth).mean() > 0.95
    assert abs(good - 0.7) < 0.1
    assert theta[1, 0, 2] > theta[1, 3, 2]


def test_edges(edge_docs, no_docs, scored):
    rows = quality.score(edge_docs, scored[0]).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if not (r["text"] or "").strip():
            assert r["quality_score"] == 0 and not r["accepted"]
    assert quality.score(no_docs, quality.fit(no_docs)).count() == 0
    assert quality.score(edge_docs, quality.fit(edge_docs)).count() == len(rows)


def test_em_against_one_document_at_a_time():
    """The same estimates from a plain loop over documents, without patterns."""
    rnd = np.random.default_rng(6)
    truth = rnd.random(300) < 0.75
    docs = np.stack([np.where(rnd.random(300) < 0.2, 0, np.where(rnd.random(300) < a, truth, ~truth) * 2 - 1) for a in (0.9, 0.8, 0.7)] + [np.where(~truth & (rnd.random(300) < 0.5), -1, 0)], axis=1)
    patterns, where, counts = np.unique(docs, axis=0, return_inverse=True, return_counts=True)
    post, theta, good = quality.expectation_maximisation(patterns, counts.astype(float), rounds=12)
    both = [any(d[k] > 0 for d in docs) for k in range(4)]
    prior = [[[0.4, 0.3, 0.3] if b else [0.29, 0.70, 0.01] for b in both], [[0.02, 0.18, 0.8] if b else [0.005, 0.99, 0.005] for b in both]]
    t, share, p = [[list(x) for x in side] for side in prior], 0.8, []
    for _ in range(12):
        p = []
        for d in docs:
            like = [np.prod([t[c][k][d[k] + 1] for k in range(4)]) for c in (0, 1)]
            p.append(share * like[1] / (share * like[1] + (1 - share) * like[0]))
        for c in (0, 1):
            for k in range(4):
                seen = [0.05 * 300 * prior[c][k][v] + sum((q if c else 1 - q) for q, d in zip(p, docs, strict=True) if d[k] + 1 == v) for v in range(3)]
                t[c][k] = [x / sum(seen) for x in seen]
        share = min(max((sum(p) + 16) / 320, 0.01), 0.99)
    assert np.allclose(post[where.ravel()], p) and np.allclose(theta, t) and abs(good - share) < 1e-9


def test_layout_of_rows_changes_no_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = (quality.fit(docs.repartition(n)) for n in (2, 40))
    assert one.bias == many.bias and (one.weight == many.weight).all() and one.accuracies == many.accuracies


def test_scores_against_words_by_regex(spark):
    """Votes and scores of short texts from a plain reading of their words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.fit(docs)
    texts = [r["text"] or "" for r in docs.limit(60).collect()]
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    for r in got.collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", texts[r["doc_id"]].encode())
        if not words:
            assert r["quality_score"] == 0.0
            continue
        sums, before, last = 0.0, None, None
        for w in words:
            kinds = 0
            for byte in w:
                kinds |= int(quality._CLASS[byte])
            folded = re.sub(rb"[A-Z]", lambda m: m[0].lower(), w)
            function = folded.decode("utf-8", "ignore") in FUNCTION
            shape = kinds << 8 | min(len(w), 15) // 3 << 2 | function << 1 | (folded == last)
            pair = 0 if before is None else before + 1
            for key in (shape + (1 << 40), shape * (1 << 20) + pair + (1 << 50)):
                place = int(quality.mix(np.array([key], np.uint64))[0]) >> 64 - quality.BITS
                sums += model.weight[place]
            before, last = shape, folded
        want = 1 / (1 + np.exp(-(model.bias + sums / (len(words) + quality.STEADY))))
        assert abs(r["quality_score"] - want) < 1e-6
