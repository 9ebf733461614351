"""Scans, lookups, subject resolution, envelope counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.bindings import Facts
from loomgraph.operators import edges, lookup
from loomgraph.plans.registry import query


def values(f: Facts, column: str, items: list[str]) -> DataFrame:
    """A stated list of query values."""
    return f.spark.sql("SELECT col1 AS " + column + " FROM VALUES " + ", ".join("('" + i.replace("'", "''") + "')" for i in items))


SYMBOL = "id, path, name, qualified, kind, start, line, durable, collisions"
EDGE = "from_id, to_id, attribution, path, line, provenance, derivation"


@query("scan_edges_decoded", f"SELECT {', '.join('c.' + x.strip() for x in EDGE.split(','))}, a.name AS from_name, b.name AS to_name FROM call_edge c JOIN symbol a ON a.id = from_id JOIN symbol b ON b.id = to_id")
def _(f: Facts) -> DataFrame:
    return edges.decoded(f.call_edge, f.symbol).selectExpr(*EDGE.split(", "), "from_name", "to_name")


@query("scan_symbols", f"SELECT {SYMBOL} FROM symbol")
def _(f: Facts) -> DataFrame:
    return f.symbol.selectExpr(*SYMBOL.split(", ")).orderBy("id", "path")


@query("lookup_symbol", f"SELECT {SYMBOL} FROM symbol WHERE id = 'p7'")
def _(f: Facts) -> DataFrame:
    return f.symbol.where("id = 'p7'").selectExpr(*SYMBOL.split(", "))


@query("lookup_by_offset", "SELECT q.path, q.start, coalesce(s.id, d.id) AS id FROM (SELECT path, start + CASE WHEN start % 3 = 0 THEN 5 WHEN start % 7 = 0 THEN 2 ELSE 0 END AS start FROM symbol) q LEFT JOIN symbol s ON s.path = q.path AND s.start = q.start LEFT JOIN declaration d ON d.path = q.path AND d.start = q.start")
def _(f: Facts) -> DataFrame:
    places = f.symbol.selectExpr("path", "start + CASE WHEN start % 3 = 0 THEN 5 WHEN start % 7 = 0 THEN 2 ELSE 0 END AS start")
    return lookup.by_offset(f.symbol, f.declaration, places)


@query("lookup_by_name", f"SELECT {SYMBOL} FROM symbol WHERE name = (SELECT p_name FROM part WHERE p_partkey = 5)")
def _(f: Facts) -> DataFrame:
    named = f.part.where("p_partkey = 5").selectExpr("p_name AS name")
    return f.symbol.join(F.broadcast(named), "name", "left_semi").selectExpr(*SYMBOL.split(", ")).orderBy("id")


@query("header_pivot", "SELECT max(CASE WHEN k = 'commit' THEN v END) AS commit_id, max(CASE WHEN k = 'files' THEN v END) AS files, max(CASE WHEN k = 'tool' THEN v END) AS tool FROM (SELECT 'commit' AS k, md5(CAST(count(*) AS STRING)) AS v FROM lineitem UNION ALL SELECT 'files', CAST(count(*) AS STRING) FROM file UNION ALL SELECT 'tool', 'one') m")
def _(f: Facts) -> DataFrame:
    meta = f.lineitem.selectExpr("'commit' AS key", "md5(CAST(count(*) AS STRING)) AS value").union(f.file.selectExpr("'files'", "CAST(count(*) AS STRING)")).union(f.spark.sql("SELECT 'tool', 'one'"))
    return lookup_header(meta)


def lookup_header(meta: DataFrame) -> DataFrame:
    """The one-row header of a key-value table."""
    return meta.groupBy().pivot("key", ["commit", "files", "tool"]).agg(F.first("value")).withColumnRenamed("commit", "commit_id")


@query("symbol_glob", f"SELECT {SYMBOL} FROM symbol WHERE regexp_matches(name, '^.*e.$') OR regexp_matches(qualified, '^.*e.$')")
def _(f: Facts) -> DataFrame:
    return lookup.glob(f.symbol, "*e?").selectExpr(*SYMBOL.split(", ")).orderBy("id", "path")


RESOLVE = ["p3", "p4000000", "no such name"]


@query(
    "resolve_subject",
    """WITH s AS (SELECT 'p3' AS subject UNION ALL SELECT 'no such name' UNION ALL SELECT (SELECT name FROM symbol WHERE id = 'p8') UNION ALL SELECT (SELECT qualified FROM symbol WHERE id = 'p9') UNION ALL SELECT (SELECT path || '#' || qualified FROM symbol WHERE id = 'p11')),
c AS (SELECT subject, id, CASE WHEN id = subject THEN 0 WHEN path || '#' || qualified = subject THEN 1 WHEN qualified = subject THEN 2 ELSE 3 END AS tier FROM s JOIN symbol ON id = subject OR path || '#' || qualified = subject OR qualified = subject OR name = subject),
m AS (SELECT subject, min(tier) AS tier FROM c GROUP BY subject)
SELECT DISTINCT c.subject, c.id, c.tier FROM c JOIN m ON m.subject = c.subject AND m.tier = c.tier""",
)
def _(f: Facts) -> DataFrame:
    some = f.symbol.where("id IN ('p8', 'p9', 'p11')").selectExpr("CASE id WHEN 'p8' THEN name WHEN 'p9' THEN qualified ELSE path || '#' || qualified END AS subject")
    return lookup.resolve_subjects(f.symbol, values(f, "subject", ["p3", "no such name"]).union(some)).distinct().orderBy("subject", "id")


@query("resolve_path", "WITH s AS (SELECT 's3.ts' AS subject UNION ALL SELECT './s7.ts' UNION ALL SELECT (SELECT path FROM file WHERE file_no = 4) UNION ALL SELECT '3.ts'), k AS (SELECT subject, regexp_replace(subject, '^\\./', '') AS key FROM s), c AS (SELECT subject, path, CASE WHEN path = key THEN 0 ELSE 1 END AS tier FROM k JOIN file ON path = key OR suffix(path, '/' || key)), m AS (SELECT subject, min(tier) AS t FROM c GROUP BY subject) SELECT c.subject, path FROM c JOIN m ON m.subject = c.subject AND t = tier".replace("\\\\", "\\"))
def _(f: Facts) -> DataFrame:
    whole = f.file.where("file_no = 4").selectExpr("path AS subject")
    return lookup.resolve_paths(f.file, values(f, "subject", ["s3.ts", "./s7.ts", "3.ts"]).union(whole)).orderBy("subject", "path")


@query("durable_ids", "SELECT id, path FROM symbol WHERE durable")
def _(f: Facts) -> DataFrame:
    return f.symbol.where("durable").select("id", "path").orderBy("id")


@query("callers", f"SELECT {EDGE} FROM call_edge WHERE to_id IN (SELECT to_id FROM call_edge GROUP BY to_id ORDER BY count(*) DESC, to_id LIMIT 3)")
def _(f: Facts) -> DataFrame:
    hubs = f.call_edge.groupBy("to_id").count().orderBy(F.desc("count"), "to_id").limit(3).select(F.col("to_id").alias("id"))
    return edges.callers(f.call_edge, hubs).selectExpr(*EDGE.split(", "))


@query("callees", f"SELECT {EDGE} FROM call_edge WHERE from_id IN ('p1', 'p2', 'p3')")
def _(f: Facts) -> DataFrame:
    return edges.callees(f.call_edge, values(f, "id", ["p1", "p2", "p3"])).selectExpr(*EDGE.split(", "))


@query("callee_steps", "SELECT from_id, to_id, count(*) AS n_sites, string_agg(path || ':' || CAST(line AS STRING), ',' ORDER BY path, line) AS sites FROM call_edge GROUP BY from_id, to_id")
def _(f: Facts) -> DataFrame:
    steps = edges.steps(f.call_edge)
    return steps.selectExpr("from_id", "to_id", "CAST(size(sites) AS BIGINT) AS n_sites", "array_join(transform(sites, s -> s.path || ':' || CAST(s.line AS STRING)), ',') AS sites")


@query("references_of", "SELECT 'out' AS direction, from_id, to_id, kind, path, line FROM reference_edge WHERE from_id IN ('p1', 'p2', 'p3') UNION ALL SELECT 'in', from_id, to_id, kind, path, line FROM reference_edge WHERE to_id IN ('p1', 'p2', 'p3') AND from_id NOT IN ('p1', 'p2', 'p3')")
def _(f: Facts) -> DataFrame:
    return edges.references(f.reference_edge, values(f, "id", ["p1", "p2", "p3"])).select("direction", "from_id", "to_id", "kind", "path", "line")


@query("budget", "SELECT least(n, 20) AS returned, n AS available, n > 20 AS truncated FROM (SELECT count(*) AS n FROM call_edge WHERE to_id = 'p1') x")
def _(f: Facts) -> DataFrame:
    return lookup.budget(f.call_edge.where("to_id = 'p1'"), 20)


@query("alias_lookup", "SELECT r.from_id, r.to_id, coalesce(d.id, e.id) AS target FROM reference_edge r LEFT JOIN symbol d ON d.id = r.to_id AND d.durable LEFT JOIN (SELECT from_id, min(to_id) AS to_id FROM reference_edge WHERE kind = 'references' GROUP BY from_id) a ON a.from_id = r.to_id LEFT JOIN symbol e ON e.id = a.to_id AND e.durable")
def _(f: Facts) -> DataFrame:
    alias = f.reference_edge.where("kind = 'references'").groupBy(F.col("from_id").alias("source")).agg(F.min("to_id").alias("target"))
    return edges.follow_alias(f.reference_edge.select("from_id", "to_id"), f.symbol.where("durable").select("id"), alias)


@query("collision_spots", "SELECT id, path, collisions FROM symbol WHERE collisions > 0")
def _(f: Facts) -> DataFrame:
    return f.symbol.where("collisions > 0").select("id", "path", "collisions").orderBy("id")


@query("nearest_key", "WITH k AS (SELECT unnest(['classify', 'remediations', 'discover', 'baselines']) AS key), t AS (SELECT unnest(['clasify', 'discovery', 'base', 'zzz', 'remediation']) AS typed), d AS (SELECT typed, key, levenshtein(typed, key) AS d FROM t, k WHERE levenshtein(typed, key) <= least(3, length(typed) // 2)) SELECT typed, min_by(key, (d, key)) AS nearest FROM d GROUP BY typed")
def _(f: Facts) -> DataFrame:
    return lookup_nearest(values(f, "typed", ["clasify", "discovery", "base", "zzz", "remediation"]), ["classify", "remediations", "discover", "baselines"])


def lookup_nearest(typed: DataFrame, keys: list[str]) -> DataFrame:
    """The known key within min(3, half the length) edits of each typed one."""
    known = typed.select("typed", F.explode(F.array(*map(F.lit, keys))).alias("key"))
    d = F.levenshtein("typed", "key")
    return known.withColumn("d", d).where(d <= F.least(F.lit(3), F.floor(F.length("typed") / 2))).groupBy("typed").agg(F.min_by("key", F.struct("d", "key")).alias("nearest"))
