"""Staleness, project rows, exclusions, reaches verdicts, bounded traces, records and canonical forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.bindings import Facts
from loomgraph.functions.text import canonical_map, squeezed
from loomgraph.operators import claims, network, upkeep, walks
from loomgraph.plans.files import _LINKS, file_links
from loomgraph.plans.registry import query
from loomgraph.sources import records

_LEFT = "CASE WHEN file_no % 5 = 0 THEN '../' || path ELSE path END AS path"


@query("external_paths", f"SELECT path FROM (SELECT {_LEFT} FROM file) q WHERE path NOT LIKE '../%'")
def _(f: Facts) -> DataFrame:
    return upkeep.inside(f.file.selectExpr(_LEFT)).orderBy("path")


_USAGE = {
    "input_tokens": "CAST(l_quantity AS BIGINT)",
    "output_tokens": "CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END",
    "cache_read_input_tokens": "CASE WHEN l_returnflag = 'A' THEN CAST(floor(l_extendedprice) AS BIGINT) END",
    "cache_creation_input_tokens": "CASE WHEN l_returnflag <> 'N' THEN l_suppkey END",
}


@query("token_sum", "SELECT l_suppkey AS case_id, CAST(sum(" + " + ".join(f"coalesce({x}, 0)" for x in _USAGE.values()) + ") AS BIGINT) AS tokens FROM lineitem GROUP BY l_suppkey")
def _(f: Facts) -> DataFrame:
    usage = F.create_map(*[c for name, x in _USAGE.items() for c in (F.lit(name), F.expr(x))])
    return f.lineitem.groupBy(F.col("l_suppkey").alias("case_id")).agg(F.sum(records.token_sum(usage)).alias("tokens"))


_ARM = "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '{\"id\":\"' || o_orderstatus || '/m\",\"toolset\":\"' || o_orderstatus || '\",\"model\":\"m\"}' END"
_MODEL = "CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 THEN 'k' || CAST(o_custkey % 3 AS STRING) END"


@query(
    "record_upgrade",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, coalesce({_MODEL}, 'unknown') AS m FROM orders)
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || '/' || m ELSE o_orderstatus || '/m' END AS arm_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS toolset, CASE WHEN o_orderkey % 2 = 0 THEN m ELSE 'm' END AS model FROM r""",
)
def _(f: Facts) -> DataFrame:
    raw = f.orders.selectExpr("o_orderkey AS run_id", f"{_ARM} AS arm", f"{_MODEL} AS model")
    return records.upgraded(raw).select("run_id", F.col("arm.id").alias("arm_id"), "arm.toolset", "arm.model")


@query("canonical_json", "SELECT o_orderkey AS run_id, '{\"cust\":\"' || CAST(o_custkey AS STRING) || '\",\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}' AS text FROM orders")
def _(f: Facts) -> DataFrame:
    parts = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("priority"), F.col("o_orderpriority"))
    return f.orders.select(F.col("o_orderkey").alias("run_id"), canonical_map(parts).alias("text"))


@query("squeezed_name", r"SELECT doc_id, substring(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 96) AS name FROM documents")
def _(f: Facts) -> DataFrame:
    return f.documents.select("doc_id", squeezed(F.col("text")).alias("name"))


@query("stale_reason", "SELECT * FROM (VALUES ('fresh', NULL), ('schema', 'schema'), ('none', 'schema'), ('empty', 'empty'), ('tool', 'tool'), ('compiler', 'compiler')) AS t(name, reason)")
def _(f: Facts) -> DataFrame:
    spark, out = f.spark, None
    for name, schema, tool, compiler in (("fresh", "1", "2", "6"), ("schema", "0", "2", "6"), ("none", None, "2", "6"), ("empty", "1", "2", "6"), ("tool", "1", "1", "5"), ("compiler", "1", "2", "5")):
        entries = [(k, v) for k, v in (("schemaVersion", schema), ("toolVersion", tool), ("compilerVersion", compiler)) if v]
        meta = spark.createDataFrame(entries, "key string, value string")
        one = upkeep.stale_reason(meta, f.symbol.limit(0) if name == "empty" else f.symbol, "2", "6", 1).select(F.lit(name).alias("name"), "reason")
        out = one if out is None else out.union(one)
    return out


@query("reanalysed_files", "SELECT DISTINCT path FROM file_project JOIN project ON config_path = project AND project.n_key % 6 = 1")
def _(f: Facts) -> DataFrame:
    return upkeep.reanalysed_files(f.file_project, f.project.where("n_key % 6 = 1")).orderBy("path")


_ROW = "config_path, fidelity, cause, fingerprint, '2026-01-01' AS analysed_at, CAST(n_key + 1 AS INT) AS root_file_count"
_FRESH = "config_path, 'syntactic' AS fidelity, cause, 'new' AS fingerprint, '2026-03-01' AS analysed_at, 5 AS root_file_count"


@query(
    "touched_projects",
    f"""WITH known AS (SELECT {_ROW} FROM project WHERE n_key % 5 > 0), fresh AS (SELECT {_FRESH} FROM project WHERE n_key % 7 = 3),
mine AS (SELECT DISTINCT file_project.project AS config_path FROM file_project JOIN file USING (path) WHERE canonical AND file_no % 9 = 2), sizes AS (SELECT project AS config_path, CAST(count(*) AS INT) AS members FROM file_project GROUP BY project)
SELECT mine.config_path, coalesce(f.fidelity, k.fidelity, 'typed') AS fidelity, coalesce(f.cause, k.cause) AS cause, coalesce(f.fingerprint, k.fingerprint) AS fingerprint, CASE WHEN f.config_path IS NULL THEN '2026-02-02' ELSE f.analysed_at END AS analysed_at, coalesce(f.root_file_count, k.root_file_count, members) AS root_file_count
FROM mine LEFT JOIN known k USING (config_path) LEFT JOIN fresh f USING (config_path) LEFT JOIN sizes USING (config_path)""",
)
def _(f: Facts) -> DataFrame:
    known = f.project.where("n_key % 5 > 0").selectExpr(*_ROW.split(", "))
    fresh = f.project.where("n_key % 7 = 3").selectExpr(*_FRESH.split(", "))
    return upkeep.touched_projects(known, f.file_project, f.file.where("file_no % 9 = 2"), fresh, "2026-02-02").orderBy("config_path")


_CHANGE = "CASE file_no % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'changed' ELSE 'removed' END"
_DARK = "SELECT file.path FROM file JOIN file_project p ON p.path = file.path AND canonical JOIN project j ON j.config_path = p.project AND j.fidelity <> 'typed' WHERE file_no % 2 = 0"


@query("impact_spots", f"SELECT path AS subject, 'fidelity-changed' AS reason FROM ({_DARK}) q UNION ALL SELECT 'baseline', 'none-stored'")
def _(f: Facts) -> DataFrame:
    return upkeep.impact_spots(_changes(f), "none-stored")


@query("impact_seeds", f"SELECT id FROM symbol JOIN file USING (path) WHERE file_no % 2 = 0 AND file_no % 3 < 2 AND path NOT IN ({_DARK})")
def _(f: Facts) -> DataFrame:
    return upkeep.seeds_of(_changes(f), f.symbol).orderBy("id")


def _changes(f: Facts) -> DataFrame:
    changes = f.file.where("file_no % 2 = 0").selectExpr("path", f"{_CHANGE} AS change")
    before = f.project.select("config_path", F.lit("typed").alias("fidelity"))
    return upkeep.exclusions(changes, f.file_project, before, f.project)


_REACH_TEXT = "CASE WHEN p_partkey % 3 = 0 THEN '! ' ELSE '' END || 'reaches(p' || CAST(p_partkey AS STRING) || ', ' || CASE WHEN p_partkey % 11 = 0 THEN 'gone' ELSE 'p' || CAST(p_partkey % 37 AS STRING) END || ')'"


@query(
    "claim_reaches_verdict",
    f"""WITH RECURSIVE c AS (SELECT p_partkey AS claim_no, {_REACH_TEXT} AS text, 'p' || CAST(p_partkey AS STRING) AS a, CASE WHEN p_partkey % 11 = 0 THEN 'gone' ELSE 'p' || CAST(p_partkey % 37 AS STRING) END AS b, p_partkey % 3 = 0 AS negated FROM part),
r AS (SELECT b, from_id AS id FROM (SELECT DISTINCT b FROM c) x JOIN sparse_edge ON to_id = b UNION SELECT b, from_id FROM r JOIN sparse_edge ON to_id = id),
dark AS (SELECT path, n_key % 4 = 1 AS syntactic FROM file),
q AS (SELECT claim_no, text, negated, x.durable AND coalesce(y.durable, TRUE) AS lasting, y.id IS NULL AS lost, dx.syntactic OR coalesce(dy.syntactic, FALSE) AS doubt, r.id IS NOT NULL AS present FROM c
  JOIN symbol x ON x.id = a LEFT JOIN symbol y ON y.id = c.b JOIN dark dx ON dx.path = x.path LEFT JOIN dark dy ON dy.path = y.path LEFT JOIN r ON r.b = c.b AND r.id = a)
SELECT claim_no, text, CASE WHEN NOT lasting THEN NULL WHEN lost OR (doubt AND NOT present) THEN 'unable-to-verify' WHEN present <> negated THEN 'verified' ELSE 'contradicted' END AS verdict,
CASE WHEN NOT lasting THEN 'local-subject' WHEN lost THEN 'unresolved' WHEN doubt AND NOT present THEN 'syntactic' WHEN present <> negated THEN 'holds' ELSE 'falsified' END AS reason FROM q""",
)
def _(f: Facts) -> DataFrame:
    asked = f.part.selectExpr("p_partkey AS claim_no", f"{_REACH_TEXT} AS text")
    doubts = f.file.select("path", (F.col("n_key") % 4 == 1).alias("syntactic"), F.lit(False).alias("broken"))
    # Walked backwards, as the pairs share few ends.
    turned = f.sparse_edge.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    pairs = claims.reach_pairs(asked).select(F.col("b").alias("a"), F.col("a").alias("b"))
    held = walks.reaches(turned, pairs, 1000).select(F.col("b").alias("a"), F.col("a").alias("b"), "holds")
    found = claims.evaluate(asked, f.symbol, f.call_edge, f.reference_edge, f.file_import, f.label, doubts, held, ("reaches",))
    return found.select("claim_no", "text", "verdict", "reason").orderBy("claim_no")


_FAN, _BUDGET = 6, 40
_TOP = "SELECT a AS path, row_number() OVER (ORDER BY sum(n) DESC, a) - 1 AS pos FROM l GROUP BY a ORDER BY pos LIMIT 3"


def _way_sql(flow: int, near: str, far: str) -> str:
    """CTEs of two hops one way: e (edges) after ``l`` (links) and ``f0`` (roots)."""
    t = f"w{'o' if flow > 0 else 'i'}"
    hop = lambda k, frontier, seen, left: (
        f"{t}k{k} AS (SELECT a, b, n, pos, row_number() OVER (PARTITION BY {near} ORDER BY n DESC, {far}) AS k FROM l JOIN {frontier} ON {near} = path),"
        f"{t}e{k} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY pos, k) AS s FROM {t}k{k} WHERE k <= {_FAN} AND {far} NOT IN ({seen})) q WHERE s <= {left}),"
        f"{t}f{k} AS (SELECT {far} AS path, min(s) AS pos FROM {t}e{k} GROUP BY 1)"
    )
    first = hop(1, "f0", "SELECT path FROM f0", f"{_BUDGET // 2}")
    second = hop(2, f"{t}f1", f"SELECT path FROM f0 UNION ALL SELECT path FROM {t}f1", f"{_BUDGET // 2} - (SELECT count(*) FROM {t}e1)")
    return f"{first},{second}"


_BOTH = f"WITH l AS (SELECT a, b, n FROM ({_LINKS}) x WHERE a <> b), f0 AS ({_TOP}), {_way_sql(-1, 'b', 'a')}, {_way_sql(1, 'a', 'b')}, e AS (" + " UNION ALL ".join(
    f"SELECT {flow} AS flow, {hop} AS hop, a, b, n, {2 - hop if flow < 0 else 1 + hop} AS slot FROM {t}e{hop}" for flow, t in ((-1, "wi"), (1, "wo")) for hop in (1, 2)
) + ")"


def _traced(f: Facts) -> tuple[DataFrame, DataFrame]:
    links = file_links(f).where("a <> b")
    top = links.groupBy(F.col("a").alias("path")).agg(F.sum("n").alias("w")).orderBy(F.desc("w"), "path").limit(3)
    numbered = network.running(top.select("path", "w", F.lit(1).alias("one"), (-F.col("w")).alias("down")), ["down", "path"], "one", "pos")
    roots = numbered.select("path", (F.col("pos") - 1).alias("pos"))
    return network.bounded_trace(links, roots, 2, "both", fan=_FAN, budget=_BUDGET), roots


@query("file_trace_both", _BOTH + " SELECT flow, hop, a, b, n, slot FROM e")
def _(f: Facts) -> DataFrame:
    return _traced(f)[0].orderBy("flow", "hop", "a", "b")


@query("file_hops", _BOTH + ", h AS (SELECT path, 0 AS hop FROM f0 UNION ALL SELECT CASE WHEN flow > 0 THEN b ELSE a END, hop FROM e) SELECT path, coalesce(min(hop), -1) AS hop FROM file LEFT JOIN h USING (path) GROUP BY path")
def _(f: Facts) -> DataFrame:
    traced, roots = _traced(f)
    return network.hop_of(traced, roots, f.file).orderBy("path")
