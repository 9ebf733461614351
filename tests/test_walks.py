"""Traversals on graphs small enough to know the answers."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import network, walks

CALLS = [("checkout", "charge"), ("charge", "StripeGateway"), ("charge", "StripeGateway.capture"), ("countdown", "countdown"), ("ping", "pong"), ("pong", "ping"), ("twice", "countdown")]


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(CALLS, "src string, dst string")


def traced(spark, calls, root, depth):
    rows = walks.paths(calls, spark.createDataFrame([(root,)], "id string"), depth).collect()
    return [(">".join(r["path"]), r["terminus"]) for r in rows]


@pytest.mark.parametrize(
    "root,depth,want",
    [
        ("checkout", 12, [("checkout>charge>StripeGateway", "leaf"), ("checkout>charge>StripeGateway.capture", "leaf")]),
        ("StripeGateway.capture", 12, [("StripeGateway.capture", "leaf")]),
        ("StripeGateway.capture", 0, [("StripeGateway.capture", "leaf")]),
        ("countdown", 12, [("countdown>countdown", "cycle")]),
        ("ping", 50, [("ping>pong>ping", "cycle")]),
        ("checkout", 1, [("checkout>charge", "depth")]),
        ("checkout", 0, [("checkout", "depth")]),
        ("nobody", 3, [("nobody", "leaf")]),
    ],
)
def test_trace(spark, calls, root, depth, want):
    assert traced(spark, calls, root, depth) == want


def test_pagerank_and_its_two_ways(spark):
    links = spark.createDataFrame([("0", "1", 1), ("1", "2", 1), ("3", "2", 1)], "a string, b string, n long")
    nodes = spark.createDataFrame([(str(i),) for i in range(4)], "id string")
    small = {r["id"]: r["rank"] for r in walks.pagerank(links, nodes).collect()}
    large = {r["id"]: r["rank"] for r in walks.pagerank(links, nodes, small=0).collect()}
    assert abs(sum(small.values()) - 1) < 1e-9 and max(small, key=small.get) == "2"
    assert all(abs(small[k] - large[k]) < 1e-12 for k in small)


def test_depth_from_entries(spark):
    edges = spark.createDataFrame([("0", "1"), ("1", "2"), ("3", "4"), ("4", "3")], "src string, dst string")
    nodes = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    assert [r["depth"] for r in walks.depth_from_entries(edges, nodes).orderBy("id").collect()] == [0, 1, 2, 2, 2]


@pytest.mark.parametrize("values,want", [([10, 30, 20, 30, 0], [2 / 8, 7 / 8, 4 / 8, 7 / 8, 0 / 8]), ([7], [0.5])])
def test_rank_normalise(spark, values, want):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int")
    assert [r["score"] for r in network.rank_normalise(df, "v").orderBy("i").collect()] == want


def random_edges(seed, n=40, m=60):
    rnd = random.Random(seed)
    return sorted({(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)})


def closure(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    out = {}
    for s in {x for e in edges for x in e}:
        seen, todo = set(), [s]
        while todo:
            for t in near.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        out[s] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reaches_both_ways(spark, seed):
    edges = random_edges(seed)
    reach = closure(edges)
    pairs = [(a, b) for a in sorted(reach)[:12] for b in sorted(reach)[::5]] + [(a, a) for a in sorted(reach)]
    e = spark.createDataFrame(edges, "src string, dst string")
    p = spark.createDataFrame(pairs, "a string, b string")
    for bound in (10**6, 0):
        got = {(r["a"], r["b"]): r["holds"] for r in walks.reaches(e, p, 100, bound).collect()}
        assert got == {(a, b): b in reach[a] for a, b in pairs}


@pytest.mark.parametrize("seed", [3, 4])
def test_strong_components(spark, seed):
    edges = random_edges(seed, 30, 55)
    reach = closure(edges)
    want = {}
    for a in reach:
        group = {b for b in reach[a] if a in reach[b]} | {a}
        if len(group) > 1:
            want[a] = (min(group), len(group))
    got = {r["id"]: (r["component"], r["size"]) for r in walks.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == want


def test_levels_are_linear_in_seeds(spark):
    edges = random_edges(5)
    e = spark.createDataFrame(edges, "src string, dst string")
    ids = sorted({x for p in edges for x in p})
    reach = lambda seeds: {r["id"] for r in walks.levels(e, spark.createDataFrame([(s,) for s in seeds], "id string"), 50).collect()}
    assert reach(ids[:2]) == reach(ids[:1]) | reach(ids[1:2])


def test_impact_keeps_the_first_discoverer(spark):
    edges = [("b", "a", "calls", 0), ("c", "a", "extends", 1), ("d", "c", "calls", 0), ("d", "b", "references", 1), ("c", "b", "calls", 0)]
    rows = walks.impact(spark.createDataFrame(edges, "src string, dst string, kind string, rank int"), spark.createDataFrame([("a",)], "id string"), 5).orderBy("depth", "id").collect()
    assert [(r["id"], r["depth"], r["through"], r["source"]) for r in rows] == [("a", 0, "changed", None), ("b", 1, "calls", "a"), ("c", 1, "extends", "a"), ("d", 2, "references", "b")]


def test_fans_of_the_nine_file_graph(spark):
    calls = [(0, 1, 4), (1, 2, 3), (1, 3, 2), (2, 4, 5), (3, 4, 2), (4, 5, 6), (2, 6, 1), (3, 6, 1)]
    imports = [(0, 6, 1), (2, 5, 1), (3, 5, 1)]
    links = spark.createDataFrame([(str(a), str(b), n) for a, b, n in calls], "a string, b string, n long")
    more = spark.createDataFrame([(str(a), str(b), n) for a, b, n in imports], "from_path string, to_path string, n long")
    nodes = spark.createDataFrame([(str(i),) for i in range(7)], "path string")
    got = {r["path"]: (r["fan_in"], r["fan_out"]) for r in network.fans(network.merged(links, more), nodes).collect()}
    assert got["0"] == (0, 2) and got["1"][0] == 1 and got["5"] == (3, 0) and got["2"][1] == 3
    assert links.select(F.sum("n")).first()[0] == 24
