import random
import re

import numpy as np

from loomgraph.llm import components, minhash


def shingle_set(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(ws) < 5:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute(rows, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingle_set(t)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df, **how):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups_of(df, **how).collect()}


def family(seed=4, groups=25, size=9):
    """Copies of texts with few words changed, so that many pairs lie near the threshold."""
    rnd = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(40, 300))]
        for _ in range(rnd.randrange(1, size)):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
                text[rnd.randrange(len(text))] = f"n{rnd.randrange(10**6)}"
            rows.append((n * 37 % 1009, " ".join(text)))
            n += 1
    return rows


def test_against_brute_force(spark):
    rows = family()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        assert found(df, percent=percent) == brute(rows, percent)


def test_links_beyond_the_bucket_centre(spark):
    """A chain in which neighbours are similar and ends are not, with the smallest id at one end."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for step in range(12):
        text = list(base)
        for k in range(step):
            text[k * 30] = f"c{k}"
        rows.append((step, " ".join(text)))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), percent=85)
    assert got == brute(rows, 85)
    assert {c for _, c in got.values()} == {0}


def test_signature_agreement_estimates_similarity():
    rnd = np.random.default_rng(1)
    a, b = np.unique(rnd.integers(0, 2**63, 3000, dtype=np.uint64)), np.unique(rnd.integers(0, 2**63, 600, dtype=np.uint64))
    other = np.unique(np.concatenate([a[: len(a) * 4 // 5], b]))
    s = minhash.circulant_signatures(np.concatenate([a, other]), np.array([len(a), len(other)]), 1024)
    true = len(np.intersect1d(a, other)) / len(np.union1d(a, other))
    assert abs((s[0] == s[1]).mean() - true) < 0.06


def test_bands_keep_the_miss_bound():
    for percent in (80, 85, 90):
        bands, rows = minhash.plan_bands(percent)
        assert bands * rows <= minhash.COORDINATES and (1 - (percent / 100) ** rows) ** bands <= minhash.MISS


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 6), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6} | {100 + i: 100 for i in range(41)}


def test_edges(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert found(edge_docs, percent=85) == brute(rows, 85)
    kept = minhash.near_duplicates(edge_docs, percent=85)
    assert kept.count() == len(rows)
    assert all(r["kept"] for r in kept.where("doc_id IS NULL").collect())
    assert kept.where("__id = 'z' AND row = 'z'").count() == len(rows)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_pages_of_one_template_give_few_pairs(spark):
    """2,000 pages that share three quarters of their shingles: they fall into common buckets, yet candidates stay linear."""
    rnd = random.Random(12)
    template = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(template + [f"p{rnd.randrange(10**9)}" for _ in range(36)])) for i in range(2000)]
    near = list(rows[7][1].split())
    near[130] = "other"
    rows.append((5000, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pages = df.selectExpr("doc_id AS id", "doc_id AS component")
    pairs = minhash.leftover_pairs(pages, df.selectExpr("doc_id AS id", "text"), 5, 85)
    assert pairs.count() < 2 * len(rows)
    assert (5000, 7) in {(r["a"], r["b"]) for r in pairs.collect()}
    got = found(df, percent=85)
    assert got[5000][1] == 7 and all(c == i for i, (_, c) in got.items() if i < 5000)


def test_leftover_pairs_miss_no_link(spark):
    rows = family(seed=8, groups=30, size=7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    alone = df.selectExpr("doc_id AS id", "doc_id AS component")
    pairs = {(r["a"], r["b"]) for r in minhash.leftover_pairs(alone, df.selectExpr("doc_id AS id", "text"), 5, 85).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    links = {(i, j) for i in sets for j in sets if i > j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert len(links) > 20 and links <= pairs


def test_an_id_with_two_texts_links_both(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (2, b), (9, a + " end")]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), percent=85)
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 5: 1, 2: 1, 9: 1}
