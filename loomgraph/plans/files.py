"""Files, projects, imports and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.bindings import Facts
from loomgraph.functions.patterns import config_glob, globbed, starred
from loomgraph.operators import edges, files
from loomgraph.plans.registry import query

_LINKS = "SELECT a.path AS a, b.path AS b, count(*) AS n FROM call_edge c JOIN symbol a ON a.id = from_id JOIN symbol b ON b.id = to_id GROUP BY 1, 2"


def file_links(f: Facts) -> DataFrame:
    """Calls between files, written once as the facts are."""
    return f.once("file_links", lambda: files.file_edges(f.call_edge, f.symbol))


@query(
    "file_report",
    """SELECT f.path, (SELECT string_agg(DISTINCT project, ',' ORDER BY project) FROM file_project p WHERE p.path = f.path) AS projects, c.project AS canonical, j.fidelity, coalesce(s.n, 0) AS symbols, coalesce(i.n, 0) AS imports, coalesce(i.broken, 0) AS broken, coalesce(t.n, 0) AS importers
FROM file f LEFT JOIN file_project c ON c.path = f.path AND c.canonical LEFT JOIN project j ON j.config_path = c.project LEFT JOIN (SELECT path, count(*) AS n FROM symbol GROUP BY path) s ON s.path = f.path
LEFT JOIN (SELECT from_path, count(*) AS n, count(*) FILTER (WHERE to_path IS NULL) AS broken FROM file_import GROUP BY 1) i ON i.from_path = f.path LEFT JOIN (SELECT to_path, count(DISTINCT from_path) AS n FROM file_import GROUP BY 1) t ON t.to_path = f.path""",
)
def _(f: Facts) -> DataFrame:
    return files.report(f.file, f.file_project, f.project, f.symbol, f.file_import).orderBy("path")


@query("projects_for_files", "SELECT path, project, canonical, fidelity, cause FROM file_project JOIN project ON config_path = project")
def _(f: Facts) -> DataFrame:
    return files.membership(f.file_project, f.project).select("path", "project", "canonical", "fidelity", "cause").orderBy("path", "project")


@query("imports_of", "SELECT from_path, specifier, to_path, to_path IS NULL AS broken, size FROM file_import LEFT JOIN file ON path = to_path")
def _(f: Facts) -> DataFrame:
    target = f.file.select(F.col("path").alias("to_path"), "size")
    return f.file_import.join(target, "to_path", "left").select("from_path", "specifier", "to_path", F.col("to_path").isNull().alias("broken"), "size")


@query("unanalysed_projects", "SELECT config_path FROM project WHERE NOT EXISTS (SELECT 1 FROM file_project p WHERE p.project = config_path)")
def _(f: Facts) -> DataFrame:
    return f.project.join(f.file_project.select(F.col("project").alias("config_path")), "config_path", "left_anti").select("config_path").orderBy("config_path")


@query("unanalysed_files", "SELECT path FROM file WHERE NOT EXISTS (SELECT 1 FROM unresolved_call u WHERE u.path = file.path AND u.cause = 'external')")
def _(f: Facts) -> DataFrame:
    return f.file.join(f.unresolved_call.where("cause = 'external'").select("path"), "path", "left_anti").select("path").orderBy("path")


@query("importers_of", "SELECT DISTINCT from_path FROM file_import WHERE to_path IN (SELECT path FROM file WHERE file_no % 9 = 0)")
def _(f: Facts) -> DataFrame:
    changed = f.file.where("file_no % 9 = 0").select(F.col("path").alias("to_path"))
    return f.file_import.join(changed, "to_path", "left_semi").select("from_path").distinct().orderBy("from_path")


@query("symbol_parents", "WITH d AS (SELECT id, path, CASE p_partkey % 3 WHEN 0 THEN name WHEN 1 THEN name || '.' || kind ELSE name || '.' || kind || '.x' END AS dotted FROM symbol JOIN part ON id = 'p' || CAST(p_partkey AS STRING)) SELECT c.id, arg_max(p.id, (length(p.dotted) - length(replace(p.dotted, '.', '')), p.id)) AS parent FROM d c LEFT JOIN d p ON p.path = c.path AND starts_with(c.dotted, p.dotted || '.') GROUP BY c.id")
def _(f: Facts) -> DataFrame:
    number = F.substring("id", 2, 20).cast("long") % 3
    dotted = F.when(number == 0, F.col("name")).when(number == 1, F.concat_ws(".", "name", "kind")).otherwise(F.concat_ws(".", "name", "kind", F.lit("x")))
    return files.suffix_parents(f.symbol.select("id", "path", dotted.alias("dotted"))).orderBy("id")


@query("symbol_children", "WITH d AS (SELECT id, CASE WHEN p_partkey >= 10 THEN 'p' || CAST(p_partkey // 10 AS STRING) END AS parent FROM symbol JOIN part ON id = 'p' || CAST(p_partkey AS STRING)) SELECT parent, count(*) AS n, string_agg(id, ',' ORDER BY id) AS children FROM d GROUP BY parent")
def _(f: Facts) -> DataFrame:
    number = F.substring("id", 2, 20).cast("long")
    tree = f.symbol.select("id", F.when(number >= 10, F.concat(F.lit("p"), F.expr("CAST(substring(id, 2) AS BIGINT) DIV 10").cast("string"))).alias("parent"))
    return tree.groupBy("parent").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("children"))


@query("index_counts", "SELECT (SELECT count(*) FROM project) AS projects, (SELECT count(*) FROM file) AS files, (SELECT count(*) FROM symbol) AS symbols, (SELECT count(*) FROM call_edge) AS calls, (SELECT count(*) FROM unresolved_call) AS unresolved")
def _(f: Facts) -> DataFrame:
    named = [("projects", f.project), ("files", f.file), ("symbols", f.symbol), ("calls", f.call_edge), ("unresolved", f.unresolved_call)]
    rows = [df.select(F.lit(n).alias("what")) for n, df in named]
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.union(r)
    return all_rows.agg(*[F.count_if(F.col("what") == n).alias(n) for n, _ in named])


@query("membership_counts", "SELECT project, count(*) AS files FROM file_project WHERE canonical GROUP BY project")
def _(f: Facts) -> DataFrame:
    return f.file_project.where("canonical").groupBy("project").agg(F.count("*").alias("files")).orderBy("project")


@query("kind_histogram", "SELECT path, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k.lower()}" for k in files.KINDS) + " FROM symbol GROUP BY path")
def _(f: Facts) -> DataFrame:
    return files.pivot_kinds(f.symbol).orderBy("path")


@query("unresolved_per_file", "SELECT path, count(*) AS n FROM unresolved_call GROUP BY path")
def _(f: Facts) -> DataFrame:
    return f.unresolved_call.groupBy("path").agg(F.count("*").alias("n")).orderBy("path")


@query("refs_in", "SELECT s.path, count(*) AS n FROM reference_edge r JOIN symbol s ON s.id = r.to_id GROUP BY s.path")
def _(f: Facts) -> DataFrame:
    per_symbol = f.reference_edge.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("k"))
    return per_symbol.join(f.symbol.select("id", "path"), "id").groupBy("path").agg(F.sum("k").alias("n")).orderBy("path")


@query("file_calls", f"SELECT * FROM ({_LINKS}) q WHERE a <> b ORDER BY n DESC, a, b LIMIT 40000")
def _(f: Facts) -> DataFrame:
    return file_links(f).where("a <> b").orderBy(F.desc("n"), "a", "b").limit(40_000)


@query("file_call_totals", f"WITH l AS ({_LINKS}) SELECT path, CAST(sum(i) AS BIGINT) AS calls_in, CAST(sum(o) AS BIGINT) AS calls_out, CAST(sum(s) AS BIGINT) AS calls_self FROM (SELECT a AS path, 0 AS i, CASE WHEN a = b THEN 0 ELSE n END AS o, CASE WHEN a = b THEN n ELSE 0 END AS s FROM l UNION ALL SELECT b, n, 0, 0 FROM l WHERE a <> b) q GROUP BY path")
def _(f: Facts) -> DataFrame:
    return files.call_totals(file_links(f)).orderBy("path")


_SYMBOL_LINKS = "SELECT from_id AS a, to_id AS b, via, count(*) AS n FROM (SELECT from_id, to_id, 0 AS via FROM call_edge UNION ALL SELECT from_id, to_id, CASE kind WHEN 'references' THEN 1 WHEN 'extends' THEN 2 WHEN 'implements' THEN 3 ELSE 4 END FROM reference_edge) q GROUP BY 1, 2, 3"


@query("symbol_links", _SYMBOL_LINKS)
def _(f: Facts) -> DataFrame:
    return edges.symbol_links(f.call_edge, f.reference_edge)


@query("links_topk", f"SELECT symbol, other, via, inbound, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol, via, inbound ORDER BY n DESC, other) AS rank FROM (SELECT a AS symbol, b AS other, via, FALSE AS inbound, n FROM ({_SYMBOL_LINKS}) x UNION ALL SELECT b, a, via, TRUE, n FROM ({_SYMBOL_LINKS}) y) z) q WHERE rank <= 24")
def _(f: Facts) -> DataFrame:
    return files.top_links(edges.symbol_links(f.call_edge, f.reference_edge), 24).withColumn("rank", F.col("rank").cast("long"))


@query("most_called", f"WITH l AS ({_LINKS}), t AS (SELECT b AS path, CAST(sum(n) AS BIGINT) AS calls_in FROM l WHERE a <> b GROUP BY b) SELECT t.path, calls_in FROM t JOIN file ON file.path = t.path WHERE n_key % 5 <> 0 ORDER BY calls_in DESC, t.path LIMIT 15")
def _(f: Facts) -> DataFrame:
    totals = file_links(f).where("a <> b").groupBy(F.col("b").alias("path")).agg(F.sum("n").alias("calls_in"))
    return totals.join(f.file.where("n_key % 5 <> 0").select("path"), "path", "left_semi").where("calls_in > 0").orderBy(F.desc("calls_in"), "path").limit(15)


@query("match_files", "SELECT path, CAST(CASE WHEN contains(lower(list_extract(string_split(path, '/'), -1)), 's1') THEN 1000 ELSE 0 END + CASE WHEN contains(lower(list_extract(string_split(path, '/'), -1)), 'r') THEN 1000 ELSE 0 END - length(path) AS BIGINT) AS score FROM file WHERE contains(lower(path), 's1') AND contains(lower(path), 'r')")
def _(f: Facts) -> DataFrame:
    return f.file.select("path", files.match_score(F.col("path"), ["s1", "r"]).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "path")


@query("symbol_collisions", "SELECT path, name, count(DISTINCT kind) AS spaces, count(*) - 1 AS extra, min(id) AS kept FROM symbol GROUP BY path, name HAVING count(DISTINCT kind) > 1")
def _(f: Facts) -> DataFrame:
    return f.symbol.groupBy("path", "name").agg(F.count_distinct("kind").alias("spaces"), (F.count("*") - 1).alias("extra"), F.min("id").alias("kept")).where("spaces > 1").orderBy("path", "name")


@query("canonical_project", "SELECT path, min(project) AS project FROM file_project GROUP BY path")
def _(f: Facts) -> DataFrame:
    return f.file_project.groupBy("path").agg(F.min("project").alias("project")).orderBy("path")


@query("skip_dirs", "SELECT path FROM (SELECT 'x/' || CASE file_no % 4 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'dist/' ELSE 'src/' END || path AS path FROM file) q WHERE NOT regexp_matches(path, '(^|/)(node_modules|dist)/')")
def _(f: Facts) -> DataFrame:
    found = f.file.selectExpr("'x/' || CASE file_no % 4 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'dist/' ELSE 'src/' END || path AS path")
    return found.where(~files.skipped(F.col("path"), ["node_modules", "dist"])).orderBy("path")


@query("source_files", "SELECT path FROM file WHERE file_no % 7 <> 0 AND file_no % 13 <> 0 AND n_key % 5 <> 0 AND NOT regexp_matches(path, 's9[0-9]*\\.ts$')".replace("\\\\", "\\"))
def _(f: Facts) -> DataFrame:
    return f.file.where("file_no % 7 <> 0 AND file_no % 13 <> 0 AND n_key % 5 <> 0").where(~F.col("path").rlike(r"s9[0-9]*\.ts$")).select("path").orderBy("path")


@query("only_called_by", "SELECT to_id, count(*) FILTER (WHERE NOT starts_with(path, 'r1/')) AS outside, count(*) AS sites FROM call_edge GROUP BY to_id")
def _(f: Facts) -> DataFrame:
    return f.call_edge.groupBy("to_id").agg(F.count_if(~F.col("path").startswith("r1/")).alias("outside"), F.count("*").alias("sites"))


@query("tsconfig_globbed", f"SELECT path FROM file WHERE path = 'r0/n0/s0.ts' OR ((regexp_matches(path, '{config_glob('r1')}') OR regexp_matches(path, '{config_glob('r2/**/s?.ts')}')) AND NOT regexp_matches(path, '{config_glob('r1/n2')}'))")
def _(f: Facts) -> DataFrame:
    return f.file.where(globbed(F.col("path"), ["r1", "r2/**/s?.ts"], ["r1/n2"], ["r0/n0/s0.ts"])).select("path").orderBy("path")


@query("discover_projects", "SELECT DISTINCT config_path FROM (SELECT config_path FROM project UNION ALL SELECT dir || '/tsconfig.build.json' FROM project WHERE n_key % 2 = 0) q WHERE NOT starts_with(config_path, 'r3/')")
def _(f: Facts) -> DataFrame:
    extra = f.project.where("n_key % 2 = 0").selectExpr("dir || '/tsconfig.build.json' AS config_path")
    return f.project.select("config_path").union(extra).distinct().where("NOT startswith(config_path, 'r3/')").orderBy("config_path")


@query("source_walk", "SELECT p AS path FROM (SELECT path || CASE file_no % 3 WHEN 0 THEN '' WHEN 1 THEN '.mjs' ELSE '.md' END AS p FROM file) q WHERE regexp_matches(p, '\\.[cm]?[jt]sx?$') AND NOT regexp_matches(p, '(^|/)n3/')".replace("\\\\", "\\"))
def _(f: Facts) -> DataFrame:
    walked = f.file.selectExpr("path || CASE file_no % 3 WHEN 0 THEN '' WHEN 1 THEN '.mjs' ELSE '.md' END AS path")
    return walked.where(F.col("path").rlike(r"\.[cm]?[jt]sx?$") & ~files.skipped(F.col("path"), ["n3"])).orderBy("path")


@query("paths_pattern", f"SELECT path, regexp_extract(path, '{starred('r1/*.ts')}', 1) AS rest FROM file WHERE regexp_matches(path, '{starred('r1/*.ts')}')")
def _(f: Facts) -> DataFrame:
    regex = starred("r1/*.ts")
    return f.file.where(F.col("path").rlike(regex)).select("path", F.regexp_extract("path", regex, 1).alias("rest"))


@query("undirected", f"WITH l AS ({_LINKS}) SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a, b, n FROM l WHERE a <> b UNION ALL SELECT b, a, n FROM l WHERE a <> b) q GROUP BY a, b")
def _(f: Facts) -> DataFrame:
    links = file_links(f).where("a <> b")
    return links.union(links.select("b", "a", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


@query("path_prefix_counts", "SELECT prefix, count(*) AS n FROM (SELECT array_to_string(string_split(path, '/')[1:i], '/') AS prefix FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM file) x) q GROUP BY prefix")
def _(f: Facts) -> DataFrame:
    return prefix_counts(f.file).orderBy("prefix")


def prefix_counts(paths: DataFrame) -> DataFrame:
    """How many files are at or below each path prefix."""
    parts = F.split("path", "/")
    each = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("prefix"))
    return each.groupBy("prefix").agg(F.count("*").alias("n"))


@query("join", "SELECT coalesce(u.path, r.path) AS path, coalesce(u.n, 0) AS unresolved, coalesce(r.n, 0) AS refs FROM (SELECT path, count(*) AS n FROM unresolved_call GROUP BY path) u FULL OUTER JOIN (SELECT path, count(*) AS n FROM reference_edge GROUP BY path) r ON r.path = u.path")
def _(f: Facts) -> DataFrame:
    u = f.unresolved_call.groupBy("path").agg(F.count("*").alias("unresolved"))
    r = f.reference_edge.groupBy("path").agg(F.count("*").alias("refs"))
    return u.join(r, "path", "full_outer").fillna(0).orderBy("path")


@query("absent_deps", "SELECT project, string_agg(pkg, ', ' ORDER BY pkg) FILTER (WHERE n <= 3) || CASE WHEN max(total) > 3 THEN ' and ' || CAST(max(total) - 3 AS STRING) || ' more' ELSE '' END AS absent FROM (SELECT project, pkg, row_number() OVER (PARTITION BY project ORDER BY pkg) AS n, count(*) OVER (PARTITION BY project) AS total FROM (SELECT DISTINCT project, specifier AS pkg FROM unresolved_specifier WHERE cause = 'unprepared') d) q GROUP BY project")
def _(f: Facts) -> DataFrame:
    found = f.unresolved_specifier.where("cause = 'unprepared'").groupBy("project").agg(F.array_sort(F.collect_set("specifier")).alias("all"))
    more = F.when(F.size("all") > 3, F.concat(F.lit(" and "), (F.size("all") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return found.select("project", F.concat(F.array_join(F.slice("all", 1, 3), ", "), more).alias("absent")).orderBy("project")


@query("attribution", "WITH s AS (SELECT from_id, path, line, a.callable AS callable, a.durable AS durable FROM call_edge c JOIN symbol a ON a.id = from_id) SELECT from_id, path, line, CASE WHEN callable THEN 'symbol' WHEN durable THEN 'variable' ELSE 'file' END AS owner_kind, CASE WHEN callable OR durable THEN from_id ELSE path END AS owner FROM s".replace("SELECT from_id, path, line, a.callable", "SELECT from_id, c.path AS path, c.line AS line, a.callable"))
def _(f: Facts) -> DataFrame:
    ends = f.symbol.select(F.col("id").alias("from_id"), "callable", "durable")
    kind = F.when(F.col("callable"), "symbol").when(F.col("durable"), "variable").otherwise("file")
    return f.call_edge.join(ends, "from_id").select("from_id", "path", "line", kind.alias("owner_kind"), F.when(kind == "file", F.col("path")).otherwise(F.col("from_id")).alias("owner"))


