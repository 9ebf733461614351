"""Queries on tables that reach beyond the ids of the smallest ones: every row counts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.bindings import facts
from loomgraph.plans.registry import QUERIES

MANY = 1700


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with more parts and suppliers, call edges between larger ids and larger event ids."""
    at = tmp_path_factory.mktemp("whole")
    old = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    for name in ("nation", "orders", "documents"):
        old(name).write.parquet(f"{at}/{name}.parquet")
    old("lineitem").withColumn("l_partkey", F.expr("CASE WHEN l_partkey < 6 THEN l_partkey ELSE l_partkey + 1500 END")).write.parquet(f"{at}/lineitem.parquet")
    old("events").withColumn("event_id", F.col("event_id") + 5000).write.parquet(f"{at}/events.parquet")
    spark.range(50).selectExpr("id AS s_suppkey", "'s' AS s_name", "CAST(id % 25 AS INT) AS s_nationkey", "1.0D AS s_acctbal").write.parquet(f"{at}/supplier.parquet")
    part = spark.range(MANY).selectExpr("id AS p_partkey", "'n' || CAST(id % 35 AS STRING) AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(20 AS INT) AS p_size", "1.0D AS p_retailprice")
    part.write.parquet(f"{at}/part.parquet")
    return str(at)


def test_claims_are_built_from_all_parts(spark, tables):
    assert facts(spark, tables).claim.count() == MANY
    assert QUERIES["claim_parse"](spark, tables).count() == MANY
    exists = QUERIES["claim_exists"](spark, tables).collect()
    assert {r["claim_no"] for r in exists} == {n for n in range(MANY) if n % 16 in (0, 1, 15)}
    assert all(r["verdict"] == "verified" for r in exists if r["claim_no"] % 16 == 0)


def test_verify_gives_every_claim_without_fault(spark, tables):
    verdicts = QUERIES["claim_verdict"](spark, tables)
    assert QUERIES["verify"](spark, tables).count() == verdicts.where("verdict IS NOT NULL").count() > 48


def reached(out, start):
    seen, todo = set(), [start]
    while todo:
        new = out.get(todo.pop(), set()) - seen
        seen |= new
        todo += new
    return seen


def hops(rows):
    out = {}
    for r in rows:
        out.setdefault(r["from_id"], set()).add(r["to_id"])
    return out


def test_cycles_between_larger_ids_are_found(spark, tables):
    f = facts(spark, tables)
    out = hops(f.call_edge.select("from_id", "to_id").collect())
    near = {v: reached(out, v) for v in out}
    groups = {v: {w for w in near[v] if v in near.get(w, ())} | {v} for v in out}
    want = {(v, min(g), len(g)) for v, g in groups.items() if len(g) > 1}
    got = {(r["id"], r["component"], r["size"]) for r in QUERIES["scc"](spark, tables).collect()}
    assert got == want and any(int(v[1:]) >= 1000 for v, _, _ in got)

    out, paths = hops(f.call_edge.where("quantity >= 30").select("from_id", "to_id").collect()), Counter()
    live = [[v] for v in sorted(out, key=lambda v: (-len(out[v]), v))[:6]]
    for d in range(5):
        ends = {">".join(p): "cycle" if p[-1] in p[:-1] else "leaf" if p[-1] not in out else "depth" if d == 4 else None for p in live}
        paths.update((k, t) for k, t in ends.items() if t)
        live = [[*p, n] for p in live if not ends[">".join(p)] for n in out[p[-1]]]
    assert Counter((r["path"], r["terminus"]) for r in QUERIES["trace_cycles"](spark, tables).collect()) == paths
    assert any("p15" in p for p, _ in paths)


def test_every_diff_is_parsed(spark, tables):
    want = Counter()
    for n, kind in facts(spark, tables).events.select("event_id", "event_type").collect():
        want.update([(n, 1, f"{kind}.ts", 1, 2, 1), (n, 1, f"{kind}.ts", 2, 0, 1)] + [(n, 2, "y.ts", 1, n % 5, 0)] * (n % 5 > 0))
    got = QUERIES["parse_diff"](spark, tables).select("doc", "file_no", "path", "hunk", "added", "removed")
    assert Counter(map(tuple, got.collect())) == want


def test_every_place_name_path_and_document_is_asked_for(spark, tables):
    f = facts(spark, tables)
    assert QUERIES["lookup_by_offset"](spark, tables).count() == MANY
    assert QUERIES["collision_spots"](spark, tables).count() == f.symbol.where("collisions > 0").count() == MANY
    assert QUERIES["specifier_spots"](spark, tables).agg(F.sum("sites")).head()[0] == f.unresolved_specifier.count()
    marked = {r["doc_id"] for r in QUERIES["discover_documents"](spark, tables).collect()}
    assert marked >= {r["doc_id"] for r in f.documents.collect() if r["doc_id"] % 4 == 0}


def test_reaching_is_asked_of_every_part(spark, tables):
    out = hops(facts(spark, tables).call_edge.select("from_id", "to_id").collect())
    want = {(f"p{k}", f"p{k % 37}", f"p{k % 37}" in reached(out, f"p{k}")) for k in range(MANY)}
    got = QUERIES["claim_reaches"](spark, tables).select("a", "b", "holds").collect()
    assert len(got) == MANY and set(map(tuple, got)) == want


def test_imports_come_from_all_sites(spark, tables):
    f = facts(spark, tables)
    sites = f.site.where("g IS NOT NULL").count()
    assert f.file_import.agg(F.sum("n")).head()[0] == sites > f.site.where("g IS NOT NULL AND l_quantity >= 40").count()


def test_waves_follow_single_imports(spark, tables, tmp_path):
    for name in ("nation", "supplier"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    line = spark.read.parquet(f"{tables}/lineitem.parquet").limit(1)
    two = [line.withColumns({"l_orderkey": F.lit(1), "l_linenumber": F.lit(k), "l_suppkey": F.lit(s), "l_quantity": F.lit(1.0), "l_discount": F.lit(0.05)}) for k, s in ((1, 1), (2, 43))]
    two[0].union(two[1]).write.parquet(f"{tmp_path}/lineitem.parquet")
    waves = {r["path"].split("/")[-1]: r["wave"] for r in QUERIES["wave_frontier"](spark, str(tmp_path)).collect()}
    assert waves == {"s3.ts": 0, "s43.ts": 0, "s1.ts": 1}
