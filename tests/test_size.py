"""What plans do with more rows: nothing is moved, sorted or asked twice that need not be."""

import duckdb
import pyarrow as pa
import pytest

from loomgraph.plans.registry import QUERIES
from loomgraph.sources import text as S

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_diffs_are_read_where_they_lie(spark):
    diff = "@@ -0 +0 @@\n+before\ndiff --git a b\n@@ -1 +1 @@\n+a\n+++ b/x.ts\n-c\n@@ -2 +2 @@\ndiff --git c d\n+++ b/y.ts\r\n@@ -3 +3 @@\n e\n+++ a\rb\n-f"
    df = S.unified_diff(spark.createDataFrame([(7, diff), (7, "diff --git x\n@@ \n-x"), (8, None), (9, "")], "k long, t string"), "k", "t")
    assert "Exchange" not in plan(df)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([(7, 1, None, 1, 1, 0), (7, 1, "x.ts", 1, 1, 1), (7, 2, "y.ts", 1, 0, 0), (7, 2, "", 1, 1, 1), (7, 1, None, 1, 0, 1)], key=repr)


def drawn(n, m, seed):
    import random

    r = random.Random(seed)
    return [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]


def closure(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    reached = {}
    for v in {x for e in edges for x in e}:
        todo, seen = list(near.get(v, ())), set()
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += near.get(x, ())
        reached[v] = seen
    return reached


def test_file_links_are_built_once(spark):
    for name in ("file_calls", "file_call_totals", "file_trace", "file_hops", "paths_of", "most_called", "label_propagation"):
        assert "facts-file_links" in plan(QUERIES[name](spark, DIR)) or name in ("file_trace", "file_hops"), name
    assert "facts-call_edge" not in plan(QUERIES["paths_of"](spark, DIR))


def test_exchanges_of_file_edges_have_parts(spark):
    from loomgraph.operators import files

    calls = spark.createDataFrame([("x", "y"), ("x", "y"), ("y", "x"), ("x", "x")], "from_id string, to_id string")
    df = files.file_edges(calls, spark.createDataFrame([("x", "f"), ("y", "g")], "id string, path string"))
    assert plan(df).count("REPARTITION_BY_NUM") == 3
    assert sorted(map(tuple, df.collect())) == [("f", "f", 1), ("f", "g", 2), ("g", "f", 1)]


def test_claims_read_the_facts_of_their_family(spark):
    assert "facts-call_edge" not in plan(QUERIES["claim_imports"](spark, DIR))
    refs = plan(QUERIES["claim_refs"](spark, DIR))
    assert "facts-call_edge" not in refs and "facts-file_import" not in refs
    verdicts = plan(QUERIES["claim_reaches_verdict"](spark, DIR))
    assert "facts-reference_edge" not in verdicts and "facts-file_import" not in verdicts


def test_facts_of_some_owners(spark):
    from loomgraph.operators import claims

    symbols = spark.createDataFrame([("x", True), ("y", True), ("z", False)], "id string, durable boolean")
    calls = spark.createDataFrame([("x", "y", "symbol"), ("y", "x", "symbol"), ("x", "z", "symbol"), ("x", "x", "file")], "from_id string, to_id string, attribution string")
    refs = spark.createDataFrame([("x", "y", "typeReferences"), ("y", "x", "extends")], "from_id string, to_id string, kind string")
    imports = spark.createDataFrame([("f", "g"), ("x", "g"), ("x", None)], "from_path string, to_path string")
    owners = spark.createDataFrame([("x",), ("z",), ("x",)], "owner string")
    got = sorted(map(tuple, claims.from_facts(symbols, calls, refs, imports, owners).collect()))
    assert got == [("x", "calls(x, y)"), ("x", "exists(x)"), ("x", "imports(x, g)"), ("x", "usesType(x, y)")]


def test_imports_by_number(spark, tmp_path):
    """Counted by file numbers where those are unique, as SQL has it where they are not."""
    import os

    from loomgraph.bindings import facts, with_bindings

    for name, twice in (("once", False), ("twice", True)):
        at = tmp_path / name
        at.mkdir()
        c = duckdb.connect()
        for t in ("supplier", "nation", "region", "lineitem", "part"):
            os.symlink(f"{DIR}/{t}.parquet", at / f"{t}.parquet")
        if twice:
            os.unlink(at / "supplier.parquet")
            c.execute(f"COPY (SELECT * FROM '{DIR}/supplier.parquet' UNION ALL SELECT * REPLACE ((s_nationkey + 1) % 25 AS s_nationkey) FROM '{DIR}/supplier.parquet' WHERE s_suppkey < 3) TO '{at}/supplier.parquet'")
        for t in ("supplier", "nation", "lineitem"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
        want = c.execute(with_bindings("SELECT from_path, specifier, to_path, n FROM file_import")).fetchall()
        got = [tuple(r) for r in facts(spark, str(at)).file_import.select("from_path", "specifier", "to_path", "n").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), name


def test_settled(spark):
    """A frame that costs work is written before it is asked again, one of files is not."""
    from loomgraph.session import settled

    files = spark.read.parquet(f"{DIR}/part.parquet")
    plain = files.where("p_size > 1").select("p_name")
    assert settled(plain, "x") is plain
    counted = settled(files.groupBy("p_name").count(), "x")
    assert "Aggregate" not in plan(counted) and counted.count() == files.select("p_name").distinct().count()


def test_mutual(spark):
    from loomgraph.operators import atlas

    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "c"), ("d", "d"), ("e", "f"), ("f", "e")], "a string, b string")
    df = atlas.mutual(links)
    assert "Join" not in plan(df)
    assert sorted(r["path"] for r in df.collect()) == ["a", "b", "e", "f"]


@pytest.mark.parametrize("seed", [1, 2])
def test_reaches_by_bits(spark, seed):
    """More starts than a group has, over sparse graphs with long ways: numbers as well as names."""
    from loomgraph.operators import walks

    edges = [*drawn(150, 170, seed), *((f"n{i}", f"n{i + 1}") for i in range(200, 220))]
    reached = closure(edges)
    pairs = [(a, b) for k, a in enumerate(sorted(reached)) for b in sorted(reached)[k % 3 :: 3]]
    pairs.append(("n200", "n220"))
    want = {(a, b): b in reached[a] for a, b in pairs}
    e, p = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "a string, b string")
    assert {(r["a"], r["b"]): r["holds"] for r in walks.reaches(e, p, 100, 0).collect()} == want
    number = lambda df: df.selectExpr(*[f"CAST(substring({c}, 2) AS BIGINT) AS {c}" for c in df.columns])
    for bound in (0, 1000):
        got = {(f"n{r['a']}", f"n{r['b']}"): r["holds"] for r in walks.reaches(number(e), number(p), 100, bound).collect()}
        assert got == want


def test_strong_components_of_drawn_graphs(spark):
    from loomgraph.operators import walks

    edges = drawn(120, 150, 3)
    reached = closure(edges)
    alike = {v: sorted(w for w in reached if w in reached[v] and v in reached[w]) for v in reached}
    want = {v: (g[0], len(g)) for v, g in alike.items() if len(g) > 1}
    df = walks.strong_components(spark.createDataFrame(edges, "src string, dst string"))
    assert {r["id"]: (r["component"], r["size"]) for r in df.collect()} == want


def test_pagerank_by_ranges(spark):
    from loomgraph.operators import walks

    edges = sorted({e for e in drawn(60, 150, 4) if e[0] != e[1]})
    links = spark.createDataFrame([(a, b, i % 5 + 1) for i, (a, b) in enumerate(edges)], "a string, b string, n long")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(60)], "id string")
    one, ranges, joins = ({r["id"]: r["rank"] for r in walks.pagerank(links, nodes, small=s, ranks=k).collect()} for s, k in ((1000, 0), (0, 1000), (0, 0)))
    assert one == pytest.approx(ranges, abs=1e-12) and one == pytest.approx(joins, abs=1e-12)


def test_facts_are_read_in_small_splits(spark, tmp_path, monkeypatch):
    """What is written once is read by tasks of SPLIT_BYTES, whose rows they hold when there are many parts."""
    from loomgraph import session
    from loomgraph.bindings import Facts

    monkeypatch.setattr(session, "SPLIT_BYTES", 64 << 10)
    at = f"{tmp_path}/rows.parquet"
    duckdb.sql(f"COPY (SELECT hash(i) AS h FROM range(200000) r(i)) TO '{at}' (ROW_GROUP_SIZE 10000, COMPRESSION uncompressed)")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"), spark.read.parquet(at).rdd.getNumPartitions()

    def read(found):
        from pyspark import TaskContext

        for batch in found:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * batch.num_rows, pa.int32())], names=["task"])

    facts = Facts(spark, DIR)
    out = facts.once("test-splits", lambda: spark.read.parquet(at).mapInArrow(read, "task int")).groupBy("task").count().collect()
    tasks = [r["count"] for r in out]
    assert sum(tasks) == 200_000 and max(tasks) <= 20_000
    assert (spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"), spark.read.parquet(at).rdd.getNumPartitions()) == before
