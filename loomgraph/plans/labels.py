"""Labels, scope, classification and conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.bindings import Facts
from loomgraph.functions.patterns import path_glob
from loomgraph.operators import labels as L
from loomgraph.plans.registry import query

_RANK = "CASE derivation " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(L.PRECEDENCE)) + " END"
_EFFECTIVE = f"SELECT node, axis, value, provenance, derivation FROM (SELECT *, row_number() OVER (PARTITION BY node, axis ORDER BY {_RANK}) AS n FROM label) q WHERE n = 1"
_WIDE = f"SELECT node, max(CASE WHEN axis = 'role' THEN value END) AS role, max(CASE WHEN axis = 'authorship' THEN value END) AS authorship FROM ({_EFFECTIVE}) e GROUP BY node"


@query("effective_labels", _EFFECTIVE)
def _(f: Facts) -> DataFrame:
    return L.effective(f.label).orderBy("node", "axis")


@query("scope_default", f"SELECT from_id, to_id, c.path, line FROM call_edge c LEFT JOIN ({_WIDE}) w ON w.node = c.path WHERE coalesce(authorship, 'authored') = 'authored'")
def _(f: Facts) -> DataFrame:
    return L.scoped(f.call_edge, f.label).where("in_scope").select("from_id", "to_id", "path", "line")


@query("scope_exclude", f"SELECT from_id, to_id, c.path, line FROM call_edge c LEFT JOIN ({_WIDE}) w ON w.node = c.path WHERE coalesce(role, 'source') = 'source' AND coalesce(authorship, 'authored') <> 'generated'")
def _(f: Facts) -> DataFrame:
    return L.scoped(f.call_edge, f.label, include={"role": "source"}, exclude={"authorship": "generated"}).where("in_scope").select("from_id", "to_id", "path", "line")


@query("scope_excluded", f"SELECT count(*) AS available, count(*) FILTER (WHERE coalesce(authorship, 'authored') <> 'authored') AS excluded FROM call_edge c LEFT JOIN ({_WIDE}) w ON w.node = c.path")
def _(f: Facts) -> DataFrame:
    return L.scoped(f.call_edge, f.label).agg(F.count("*").alias("available"), F.count_if(~F.col("in_scope")).alias("excluded"))


@query("conditions_touched", "SELECT config_path, cause FROM project WHERE cause IS NOT NULL AND config_path IN (SELECT project FROM file_project WHERE path IN (SELECT path FROM call_edge WHERE to_id = 'p1'))")
def _(f: Facts) -> DataFrame:
    touched = f.call_edge.where("to_id = 'p1'").select("path").distinct()
    owners = f.file_project.join(touched, "path", "left_semi").select(F.col("project").alias("config_path")).distinct()
    return f.project.where("cause IS NOT NULL").join(owners, "config_path", "left_semi").select("config_path", "cause").orderBy("config_path")


@query("classification_counts", f"SELECT role, authorship, count(*) AS files, string_agg(DISTINCT d, ',' ORDER BY d) AS derivations FROM (SELECT w.node, w.role, w.authorship, e.derivation AS d FROM ({_WIDE}) w JOIN ({_EFFECTIVE}) e ON e.node = w.node) q GROUP BY role, authorship".replace("count(*) AS files", "count(DISTINCT node) AS files"))
def _(f: Facts) -> DataFrame:
    e = L.effective(f.label)
    per_file = e.groupBy("node").agg(F.max(F.when(F.col("axis") == "role", F.col("value"))).alias("role"), F.max(F.when(F.col("axis") == "authorship", F.col("value"))).alias("authorship"), F.collect_set("derivation").alias("d"))
    return per_file.groupBy("role", "authorship").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("d")))), ",").alias("derivations"))


@query("label_disagreements", "SELECT node, axis, string_agg(DISTINCT value, ',' ORDER BY value) AS found FROM label WHERE derivation <> 'default' GROUP BY node, axis HAVING count(DISTINCT value) > 1")
def _(f: Facts) -> DataFrame:
    return L.disagreements(f.label).orderBy("node", "axis")


@query("inferred_files", f"SELECT DISTINCT node FROM ({_EFFECTIVE}) e WHERE provenance = 'inferred' AND derivation <> 'default'")
def _(f: Facts) -> DataFrame:
    return L.effective(f.label).where("provenance = 'inferred' AND derivation <> 'default'").select("node").distinct().orderBy("node")


RULES = [(path_glob("r1/**"), "test", None), (path_glob("r?/n2/*"), "source", "generated"), (path_glob("**/s1*.ts"), None, "authored"), (path_glob("r2/**/s?.ts"), "config", None)]


def _rules_sql(axis: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(path, '{r[0]}') THEN '{r[axis]}'" for r in reversed(RULES) if r[axis]) + " END"


@query("classify_rules", f"SELECT path, {_rules_sql(1)} AS role, {_rules_sql(2)} AS authorship FROM file".replace("\\", "\\"))
def _(f: Facts) -> DataFrame:
    return L.classify(f.file.select("path"), RULES).orderBy("path")


REMEDIES = [("apps/", "install"), ("r1/", "generate"), ("r", "build")]


@query("remediation_for", "SELECT config_path, CASE WHEN starts_with(config_path, 'apps/') THEN 'install' WHEN starts_with(config_path, 'r1/') THEN 'generate' WHEN starts_with(config_path, 'r') THEN 'build' END AS run FROM project WHERE cause IN ('unprepared', 'missing-generated')")
def _(f: Facts) -> DataFrame:
    run = F.lit(None).cast("string")
    for prefix, command in reversed(REMEDIES):
        run = F.when(F.col("config_path").startswith(prefix), command).otherwise(run)
    return f.project.where("cause IN ('unprepared', 'missing-generated')").select("config_path", run.alias("run")).orderBy("config_path")


_VARIANT = "CASE file_no % 6 WHEN 0 THEN 'src/__tests__/' WHEN 1 THEN 'src/generated/' WHEN 2 THEN 'e2e/' ELSE 'lib/' END || path || CASE file_no % 5 WHEN 0 THEN '.spec.ts' WHEN 1 THEN '.config.js' WHEN 2 THEN '_pb.js' ELSE '' END"


def _either(regexes: tuple[str, ...]) -> str:
    return " OR ".join(f"regexp_matches(p, '{r}')" for r in regexes)


@query("role_from_path", f"SELECT p AS path, CASE WHEN {_either(L.TEST_PATHS)} THEN 'test' WHEN {_either(L.CONFIG_PATHS)} THEN 'config' END AS role FROM (SELECT {_VARIANT} AS p FROM file) q")
def _(f: Facts) -> DataFrame:
    return f.file.selectExpr(f"{_VARIANT} AS path").withColumn("role", L.role_from_path(F.col("path")))


@query("codegen_path", f"SELECT p AS path, {_either(L.CODEGEN_PATHS)} AS generated FROM (SELECT {_VARIANT} AS p FROM file) q")
def _(f: Facts) -> DataFrame:
    return f.file.selectExpr(f"{_VARIANT} AS path").withColumn("generated", L.codegen_path(F.col("path")))


_HEAD = "CASE WHEN doc_id % 4 = 0 THEN '// @generated by tool' || chr(10) WHEN doc_id % 4 = 1 THEN chr(10) || chr(10) || '/* DO NOT EDIT */' || chr(10) WHEN doc_id % 4 = 2 THEN repeat(chr(10), 6) || '// Code generated' ELSE '' END || text"


@query("generated_header", f"SELECT doc_id, len(list_filter(string_split(substring(t, 1, 512), chr(10))[1:5], lambda x: regexp_matches(lower(x), '@generated|do not edit|auto-?generated|code generated'))) > 0 AS generated FROM (SELECT doc_id, {_HEAD} AS t FROM documents) q")
def _(f: Facts) -> DataFrame:
    return f.documents.selectExpr("doc_id", f"{_HEAD} AS t").select("doc_id", L.generated_header(F.col("t")).alias("generated"))


@query(
    "label_pass",
    f"""WITH p AS (SELECT path AS node, file_no % 17 = 0 AS untracked, file_no % 11 = 0 AS headed FROM file),
r AS (SELECT path, {_rules_sql(1)} AS role, {_rules_sql(2)} AS authorship FROM file)
SELECT node, 'role' AS axis, 'source' AS value, 'default' AS derivation FROM p UNION ALL SELECT node, 'authorship', 'authored', 'default' FROM p
UNION ALL SELECT node, 'authorship', 'generated', 'git-untracked' FROM p WHERE untracked UNION ALL SELECT node, 'authorship', 'generated', 'generated-header' FROM p WHERE headed
UNION ALL SELECT path, 'role', role, 'user-config' FROM r WHERE role IS NOT NULL UNION ALL SELECT path, 'authorship', authorship, 'user-config' FROM r WHERE authorship IS NOT NULL""",
)
def _(f: Facts) -> DataFrame:
    files = f.file.selectExpr("path", "file_no % 17 = 0 AS untracked", "CASE WHEN file_no % 11 = 0 THEN '// @generated' ELSE 'let x' END AS head")
    return L.signals(files, RULES).select("node", "axis", "value", "derivation")


@query("specifier_spots", "SELECT specifier, cause, count(*) AS sites FROM unresolved_specifier GROUP BY specifier, cause")
def _(f: Facts) -> DataFrame:
    return f.unresolved_specifier.groupBy("specifier", "cause").agg(F.count("*").alias("sites")).orderBy("specifier", "cause")


@query("withheld_spots", "SELECT path, min(reason) AS reason FROM (SELECT path, 'drifted' AS reason FROM file WHERE file_no % 4 = 0 UNION ALL SELECT path, 'moved' FROM file WHERE n_key % 6 = 0 UNION ALL SELECT path, 'unanalysed' FROM file WHERE file_no % 31 = 0) q GROUP BY path")
def _(f: Facts) -> DataFrame:
    parts = [f.file.where(w).select("path", F.lit(r).alias("reason")) for w, r in (("file_no % 4 = 0", "drifted"), ("n_key % 6 = 0", "moved"), ("file_no % 31 = 0", "unanalysed"))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("path").agg(F.min("reason").alias("reason")).orderBy("path")


@query("doctor_findings", "SELECT project, cause, count(DISTINCT specifier) AS specifiers, count(*) AS sites, count(DISTINCT path) AS files, cause IN ('unprepared', 'missing-generated') AS remediable FROM unresolved_specifier GROUP BY project, cause")
def _(f: Facts) -> DataFrame:
    return doctor(f.unresolved_specifier).orderBy("project", "cause")


def doctor(specifiers: DataFrame) -> DataFrame:
    """Findings per (project, cause). Two levels of grouping, so no distinct count expands the rows."""
    sites = specifiers.groupBy("project", "cause", "specifier").agg(F.count("*").alias("sites"), F.collect_set("path").alias("paths"))
    return sites.groupBy("project", "cause").agg(F.count("*").alias("specifiers"), F.sum("sites").alias("sites"), F.size(F.array_distinct(F.flatten(F.collect_set("paths")))).cast("long").alias("files")).withColumn("remediable", F.col("cause").isin("unprepared", "missing-generated"))


@query("evidence_topn", "SELECT kind, id, total, n FROM (SELECT kind, id, count(*) OVER (PARTITION BY kind) AS total, row_number() OVER (PARTITION BY kind ORDER BY id, line) AS n FROM (SELECT 'callers' AS kind, from_id AS id, line FROM call_edge WHERE to_id = 'p5' UNION ALL SELECT 'callees', to_id, line FROM call_edge WHERE from_id = 'p5' UNION ALL SELECT 'references', from_id, line FROM reference_edge WHERE to_id = 'p5') e) q WHERE n <= 5")
def _(f: Facts) -> DataFrame:
    kinds = f.call_edge.where("to_id = 'p5'").selectExpr("'callers' AS kind", "from_id AS id", "line").union(f.call_edge.where("from_id = 'p5'").selectExpr("'callees'", "to_id", "line")).union(f.reference_edge.where("to_id = 'p5'").selectExpr("'references'", "from_id", "line"))
    return evidence(kinds, 5)


def evidence(facts: DataFrame, limit: int) -> DataFrame:
    """Facts tagged by kind, each kind cut to ``limit`` by itself, with how many it had."""
    totals = facts.groupBy("kind").agg(F.count("*").alias("total"))
    from pyspark.sql.window import Window

    numbered = facts.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("id", "line")).cast("long"))
    return numbered.where(F.col("n") <= limit).join(F.broadcast(totals), "kind").select("kind", "id", "total", "n").orderBy("kind", "n")
