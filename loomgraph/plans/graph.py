"""Traversals and network measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.bindings import Facts
from loomgraph.operators import network, walks
from loomgraph.plans.files import _LINKS, file_links
from loomgraph.plans.registry import query

_PATHS = """WITH RECURSIVE e AS (SELECT DISTINCT {src} AS src, {dst} AS dst FROM {edges}),
roots AS ({roots}),
r AS (SELECT [id] AS path, id AS tail, FALSE AS back, 0 AS d FROM roots UNION ALL SELECT list_append(path, dst), dst, list_contains(path, dst), d + 1 FROM r JOIN e ON src = tail WHERE NOT back AND d < {depth})
SELECT array_to_string(path, '>') AS path, CASE WHEN back THEN 'cycle' WHEN NOT EXISTS (SELECT 1 FROM e WHERE src = tail) THEN 'leaf' ELSE 'depth' END AS terminus FROM r
WHERE back OR d = {depth} OR NOT EXISTS (SELECT 1 FROM e WHERE src = tail)"""
_HUBS = "SELECT from_id AS id FROM sparse_edge GROUP BY from_id ORDER BY count(*) DESC, from_id LIMIT 3"


def _hubs(f: Facts) -> DataFrame:
    return f.sparse_edge.groupBy("from_id").count().orderBy(F.desc("count"), "from_id").limit(3).select(F.col("from_id").alias("id"))


def _sparse(f: Facts, src: str = "from_id", dst: str = "to_id") -> DataFrame:
    return f.sparse_edge.select(F.col(src).alias("src"), F.col(dst).alias("dst"))


def _calls(f: Facts, src: str = "from_id", dst: str = "to_id") -> DataFrame:
    return f.call_edge.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.array_join("path", ">").alias("path"), "terminus")


@query("trace_paths", _PATHS.format(src="from_id", dst="to_id", edges="sparse_edge", roots=_HUBS, depth=6))
def _(f: Facts) -> DataFrame:
    return _shown(walks.paths(_sparse(f), _hubs(f), 6))


@query("trace_depth", _PATHS.format(src="from_id", dst="to_id", edges="sparse_edge", roots=_HUBS, depth=2))
def _(f: Facts) -> DataFrame:
    return _shown(walks.paths(_sparse(f), _hubs(f), 2))


_DENSE = "(SELECT from_id, to_id FROM call_edge WHERE quantity >= 30)"
_DENSE_ROOTS = "SELECT from_id AS id FROM call_edge WHERE quantity >= 30 GROUP BY from_id ORDER BY count(*) DESC, from_id LIMIT 6"


@query("trace_cycles", _PATHS.format(src="from_id", dst="to_id", edges=f"{_DENSE} q", roots=_DENSE_ROOTS, depth=4))
def _(f: Facts) -> DataFrame:
    dense = f.call_edge.where("quantity >= 30").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    roots = dense.groupBy("src").count().orderBy(F.desc("count"), "src").limit(6).select(F.col("src").alias("id"))
    return _shown(walks.paths(dense, roots, 4))


_SINKS = "SELECT to_id AS id FROM sparse_edge GROUP BY to_id ORDER BY count(*) DESC, to_id LIMIT 3"


@query("trace_inward", _PATHS.format(src="to_id", dst="from_id", edges="sparse_edge", roots=_SINKS, depth=3))
def _(f: Facts) -> DataFrame:
    sinks = f.sparse_edge.groupBy("to_id").count().orderBy(F.desc("count"), "to_id").limit(3).select(F.col("to_id").alias("id"))
    return _shown(walks.paths(_sparse(f, "to_id", "from_id"), sinks, 3))


_IMPACT_EDGES = "SELECT from_id AS src, to_id AS dst, 'calls' AS kind, 0 AS rank FROM call_edge UNION SELECT from_id, to_id, kind, 1 FROM reference_edge"


def _impact_sql(depth: int, columns: str) -> str:
    ctes = [f"e AS ({_IMPACT_EDGES})", "v0 AS (SELECT 'p' || CAST(p_partkey AS STRING) AS id, 0 AS depth, 'changed' AS through, CAST(NULL AS VARCHAR) AS source, ['p' || CAST(p_partkey AS STRING)] AS trail FROM part WHERE p_partkey % 97 = 5)"]
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT id FROM v{k}" for k in range(d))
        ctes.append(f"v{d} AS (SELECT id, {d} AS depth, kind AS through, dst AS source, key AS trail FROM (SELECT src AS id, dst, kind, list_append(list_append(trail, CAST(rank AS VARCHAR) || kind), src) AS key, row_number() OVER (PARTITION BY src ORDER BY list_append(list_append(trail, CAST(rank AS VARCHAR) || kind), src)) AS n FROM e JOIN v{d - 1} ON v{d - 1}.id = dst) q WHERE n = 1 AND id NOT IN ({before}))")
    every = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(depth + 1))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {columns} FROM ({every}) q"


def _impact(f: Facts, depth: int) -> DataFrame:
    calls = f.call_edge.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lit("calls").alias("kind"), F.lit(0).alias("rank"))
    refs = f.reference_edge.select("from_id", "to_id", "kind", F.lit(1))
    return walks.impact(calls.union(refs).distinct(), f.part.where("p_partkey % 97 = 5").selectExpr("'p' || CAST(p_partkey AS STRING) AS id"), depth)


@query("impact_bfs", _impact_sql(3, "id, depth, through, source"))
def _(f: Facts) -> DataFrame:
    return _impact(f, 3).orderBy("depth", "id")


@query("impact_depth", _impact_sql(2, "depth, through, count(*) AS n") + " GROUP BY depth, through")
def _(f: Facts) -> DataFrame:
    return _impact(f, 2).groupBy("depth", "through").agg(F.count("*").alias("n")).orderBy("depth", "through")


@query("claim_reaches", "WITH RECURSIVE p AS (SELECT 'p' || CAST(p_partkey AS STRING) AS a, 'p' || CAST(p_partkey % 37 AS STRING) AS b FROM part), e AS (SELECT DISTINCT from_id, to_id FROM call_edge), r AS (SELECT b, from_id AS id FROM (SELECT DISTINCT b FROM p) x JOIN e ON to_id = b UNION SELECT b, from_id FROM r JOIN e ON to_id = id) SELECT p.a, p.b, r.id IS NOT NULL AS holds FROM p LEFT JOIN r ON r.b = p.b AND r.id = p.a")
def _(f: Facts) -> DataFrame:
    # Searched backwards, as all pairs share 37 ends; by the numbers of symbols, which are shorter than their ids.
    pairs = f.part.selectExpr("p_partkey % 37 AS a", "p_partkey AS b")
    turned = f.call_edge.select(F.col("to_no").alias("src"), F.col("from_no").alias("dst"))
    named = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    return walks.reaches(turned, pairs, 1000).select(named("b").alias("a"), named("a").alias("b"), "holds").orderBy("a", "b")


_TOP = "SELECT a AS path FROM l WHERE a <> b GROUP BY a ORDER BY sum(n) DESC, a LIMIT 5"


def _hop_sql(near: str, far: str) -> str:
    ranked = "SELECT a, b, n, row_number() OVER (PARTITION BY {near} ORDER BY n DESC, {far}) AS k FROM l JOIN {frontier} ON {near} = path WHERE a <> b".replace("{near}", near).replace("{far}", far)
    return f"""WITH l AS ({_LINKS}), f0 AS ({_TOP}), e1 AS (SELECT a, b, n FROM ({ranked.replace('{frontier}', 'f0')}) q WHERE k <= 24 AND {far} NOT IN (SELECT path FROM f0)), f1 AS (SELECT DISTINCT {far} AS path FROM e1),
e2 AS (SELECT a, b, n FROM ({ranked.replace('{frontier}', 'f1')}) q WHERE k <= 24 AND {far} NOT IN (SELECT path FROM f0 UNION ALL SELECT path FROM f1))
SELECT a, b, n, 1 AS hop FROM e1 UNION ALL SELECT a, b, n, 2 FROM e2"""


def _trace_files(f: Facts, near: str, far: str) -> DataFrame:
    links = file_links(f).where("a <> b")
    roots = links.groupBy("a").agg(F.sum("n").alias("w")).orderBy(F.desc("w"), "a").limit(5).select(F.col("a").alias("path"))
    return network.file_trace(links, roots, near, far, hops=2, fan=24).select("a", "b", "n", "hop")


@query("file_trace", _hop_sql("a", "b"))
def _(f: Facts) -> DataFrame:
    return _trace_files(f, "a", "b")


@query("file_trace_in", _hop_sql("b", "a"))
def _(f: Facts) -> DataFrame:
    return _trace_files(f, "b", "a")


@query("paths_of", f"WITH l AS ({_LINKS}), t AS ({_TOP.replace('LIMIT 5', 'LIMIT 1')}) SELECT 'out' AS direction, b AS path, n FROM l JOIN t ON a = t.path WHERE a <> b UNION ALL SELECT 'in', a, n FROM l JOIN t ON b = t.path WHERE a <> b")
def _(f: Facts) -> DataFrame:
    links = file_links(f).where("a <> b")
    top = F.broadcast(links.groupBy("a").agg(F.sum("n").alias("w")).orderBy(F.desc("w"), "a").limit(1).select(F.col("a").alias("t")))
    out = links.join(top, F.col("a") == F.col("t")).select(F.lit("out").alias("direction"), F.col("b").alias("path"), "n")
    return out.union(links.join(top, F.col("b") == F.col("t")).select(F.lit("in"), "a", "n")).orderBy("direction", F.desc("n"), "path")


ROUNDS = 40


def _rank_sql() -> str:
    ctes = [f"l AS (SELECT a, b, n FROM ({_LINKS}) x WHERE a <> b)", "s AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS w FROM l)", "nodes AS (SELECT path AS id, path NOT IN (SELECT a FROM l) AS dangling, count(*) OVER () AS n FROM file)", "r0 AS MATERIALIZED (SELECT id, 1.0 / n AS rank FROM nodes)"]
    for k in range(1, ROUNDS + 1):
        ctes.append(f"r{k} AS MATERIALIZED (SELECT nodes.id, 0.15 / n + 0.85 * (coalesce(i, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} JOIN nodes USING (id) WHERE dangling) / n) AS rank FROM nodes LEFT JOIN (SELECT b AS id, sum(rank * w) AS i FROM s JOIN r{k - 1} ON r{k - 1}.id = a GROUP BY b) q ON q.id = nodes.id)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT id, round(CAST(rank AS DOUBLE), 6) AS rank FROM r{ROUNDS}"


def _file_links(f: Facts) -> DataFrame:
    return file_links(f).where("a <> b")


@query("pagerank", _rank_sql())
def _(f: Facts) -> DataFrame:
    return walks.pagerank(_file_links(f), f.file.select(F.col("path").alias("id")), ROUNDS).select("id", F.round("rank", 6).alias("rank")).orderBy("id")


_DEPTH_SQL = "WITH RECURSIVE n AS (SELECT DISTINCT id FROM (SELECT from_id AS id FROM call_edge UNION ALL SELECT to_id FROM call_edge) q), r AS (SELECT id, 0 AS d FROM n WHERE id NOT IN (SELECT to_id FROM call_edge WHERE from_id <> to_id) UNION SELECT to_id, d + 1 FROM r JOIN call_edge ON from_id = id WHERE d < 60), m AS (SELECT id, min(d) AS d FROM r GROUP BY id) SELECT n.id, CAST(coalesce(m.d, (SELECT coalesce(max(d), 0) FROM m)) AS BIGINT) AS depth FROM n LEFT JOIN m ON m.id = n.id"


@query("bfs_depth", _DEPTH_SQL)
def _(f: Facts) -> DataFrame:
    return _depths(_calls(f))


@query("bfs_depth_sparse", _DEPTH_SQL.replace("call_edge", "sparse_edge"))
def _(f: Facts) -> DataFrame:
    return _depths(_sparse(f))


def _depths(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return walks.depth_from_entries(edges, nodes).orderBy("id")


@query("scc", "WITH RECURSIVE e AS (SELECT DISTINCT from_id AS s, to_id AS t FROM call_edge WHERE from_no <> to_no), r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t), m AS (SELECT x.s AS id, least(x.s, min(x.t)) AS component FROM r x JOIN r y ON y.s = x.t AND y.t = x.s WHERE x.s <> x.t GROUP BY x.s) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM m")
def _(f: Facts) -> DataFrame:
    return walks.strong_components(f.call_edge.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")))


@query("fan_in_out", f"WITH l AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a, b, n FROM ({_LINKS}) x UNION ALL SELECT from_path, to_path, n FROM file_import WHERE to_path IS NOT NULL) q WHERE a <> b GROUP BY a, b) SELECT path, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM file LEFT JOIN (SELECT b, count(*) AS i FROM l GROUP BY b) x ON x.b = path LEFT JOIN (SELECT a, count(*) AS o FROM l GROUP BY a) y ON y.a = path")
def _(f: Facts) -> DataFrame:
    return network.fans(network.merged(_file_links(f), f.file_import), f.file.select("path")).orderBy("path")


_FANS = f"SELECT path, (SELECT count(DISTINCT a) FROM ({_LINKS}) x WHERE b = path AND a <> b) AS fan_in, (SELECT count(DISTINCT b) FROM ({_LINKS}) x WHERE a = path AND a <> b) AS fan_out FROM file"


@query("rank_normalise", f"SELECT path, CASE WHEN n <= 1 THEN 0.5 ELSE (r - 1 + r - 1 + c - 1) / 2.0 / (n - 1) END AS score FROM (SELECT path, rank() OVER (ORDER BY fan_in) AS r, count(*) OVER (PARTITION BY fan_in) AS c, count(*) OVER () AS n FROM ({_FANS}) f) q".replace("THEN 0.5", "THEN CAST(0.5 AS DOUBLE)"))
def _(f: Facts) -> DataFrame:
    fans = network.fans(_file_links(f), f.file.select("path"))
    return network.rank_normalise(fans, "fan_in").select("path", "score").orderBy("path")


@query("graph_summary", f"SELECT count(*) AS files, round(avg(fan_out), 6) AS mean_fan_out, round(avg(CASE WHEN fan_out = 0 THEN 1.0 ELSE 0.0 END), 6) AS leaf_share FROM ({_FANS}) f")
def _(f: Facts) -> DataFrame:
    fans = network.fans(_file_links(f), f.file.select("path"))
    return fans.agg(F.count("*").alias("files"), F.round(F.avg("fan_out"), 6).alias("mean_fan_out"), F.round(F.avg(F.when(F.col("fan_out") == 0, 1.0).otherwise(0.0)), 6).alias("leaf_share"))


_REGION = f"WITH l AS ({_LINKS}), x AS (SELECT p.n_key AS ra, q.n_key AS rb, count(*) AS e, CAST(sum(n) AS BIGINT) AS n FROM l JOIN file p ON p.path = a JOIN file q ON q.path = b WHERE a <> b GROUP BY 1, 2)"


@query("region_flow", _REGION + " SELECT CAST(r AS BIGINT) AS region, CAST(sum(i) AS BIGINT) AS internal, CAST(sum(b) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound FROM (SELECT ra AS r, CASE WHEN ra = rb THEN e ELSE 0 END AS i, 0 AS b, CASE WHEN ra <> rb THEN e ELSE 0 END AS o FROM x UNION ALL SELECT rb, 0, e, 0 FROM x WHERE ra <> rb) z GROUP BY r")
def _(f: Facts) -> DataFrame:
    return network.region_flow(_file_links(f), f.file.select("path", F.col("n_key").cast("long").alias("region"))).orderBy("region")


@query("region_stats", _REGION + ", w AS (SELECT CAST(r AS BIGINT) AS region, CAST(sum(i) AS BIGINT) AS internal, CAST(sum(b) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound FROM (SELECT ra AS r, CASE WHEN ra = rb THEN e ELSE 0 END AS i, 0 AS b, CASE WHEN ra <> rb THEN e ELSE 0 END AS o FROM x UNION ALL SELECT rb, 0, e, 0 FROM x WHERE ra <> rb) z GROUP BY r), c AS (SELECT CAST(n_key AS BIGINT) AS region, count(*) AS files FROM file GROUP BY 1) SELECT c.region, files, round(files / sum(files) OVER (), 6) AS share, round(CASE WHEN coalesce(inbound + outbound, 0) = 0 THEN 0.5 ELSE inbound / (inbound + outbound) END, 6) AS foundation, round(coalesce(internal, 0) / files, 6) AS density FROM c LEFT JOIN w ON w.region = c.region".replace("THEN 0.5", "THEN CAST(0.5 AS DOUBLE)"))
def _(f: Facts) -> DataFrame:
    regions = f.file.select("path", F.col("n_key").cast("long").alias("region"))
    return network.region_stats(_file_links(f), regions).orderBy("region")


@query("region_suggest", _REGION + ", c AS (SELECT n_key AS region, count(*) AS files FROM file GROUP BY 1), d AS (SELECT c.region, files, coalesce(e, 0) / files AS density FROM c LEFT JOIN x ON ra = c.region AND rb = c.region), s AS (SELECT sum(density * files) / sum(files) AS energy FROM d) SELECT round(energy, 6) AS energy, CASE WHEN energy >= 20 THEN 'dense' WHEN energy >= 2 THEN 'woven' ELSE 'sparse' END AS kind FROM s")
def _(f: Facts) -> DataFrame:
    stats = network.region_stats(_file_links(f), f.file.select("path", F.col("n_key").cast("long").alias("region")), digits=None)
    energy = F.sum(F.col("density") * F.col("files")) / F.sum("files")
    return stats.agg(energy.alias("e")).select(F.round("e", 6).alias("energy"), F.when(F.col("e") >= 20, "dense").when(F.col("e") >= 2, "woven").otherwise("sparse").alias("kind"))


@query("label_propagation")
def _(f: Facts) -> DataFrame:
    return network.label_propagation(_file_links(f), f.file.select("path", F.col("n_key").cast("long").alias("region"))).orderBy("path")


@query("dependency_paths")
def _(f: Facts) -> DataFrame:
    links = _file_links(f)
    weight = links.groupBy("a").agg(F.sum("n").alias("centrality")).withColumnRenamed("a", "id")
    return network.dependency_paths(links, weight)


@query("subsystems")
def _(f: Facts) -> DataFrame:
    return network.subsystems(f.file.select("path"))


@query("display_name", "SELECT path, coalesce(list_extract(list_filter(string_split(path, '/'), lambda p: p NOT IN ('src', 'lib', 'packages', 'apps', 'index.ts') AND NOT regexp_matches(p, '^s[0-9]*5\\.ts$')), -1), path) AS name FROM file".replace("\\\\", "\\"))
def _(f: Facts) -> DataFrame:
    generic = lambda p: p.isin("src", "lib", "packages", "apps", "index.ts") | p.rlike(r"^s[0-9]*5\.ts$")
    named = F.filter(F.split("path", "/"), lambda p: ~generic(p))
    return f.file.select("path", F.coalesce(F.try_element_at(named, F.lit(-1)), F.col("path")).alias("name")).orderBy("path")


