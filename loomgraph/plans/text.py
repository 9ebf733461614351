"""Text sources, scalar text functions, specifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.bindings import Facts
from loomgraph.functions import specifiers
from loomgraph.functions.patterns import path_glob
from loomgraph.operators import atlas
from loomgraph.plans.registry import query
from loomgraph.sources import text as S

_DOC = "text || chr(10) || CASE doc_id % 4 WHEN 0 THEN '<!-- claim: exists(p1) -->' WHEN 1 THEN '[a](./x.md#y) and [b](https://h/z) [c](<../q r>)' ELSE '[d](#top) [e](//h/i) [f](lib/p.ts?x)' END"


@query("discover_documents", f"SELECT doc_id, length(t) AS chars FROM (SELECT doc_id, {_DOC} AS t FROM documents) q WHERE contains(t, '<!-- claim:')")
def _(f: Facts) -> DataFrame:
    found = f.documents.selectExpr("doc_id", f"{_DOC} AS t")
    return found.where(F.col("t").contains("<!-- claim:")).select("doc_id", F.length("t").cast("long").alias("chars"))


_LINK_SQL = f"SELECT doc_id, unnest(regexp_extract_all({_DOC}, '{S.LINK}', 1)) AS target FROM documents"


@query("md_links", f"SELECT target, count(*) AS n FROM ({_LINK_SQL}) q GROUP BY target")
def _(f: Facts) -> DataFrame:
    return f.documents.select(F.explode(S.links(F.expr(_DOC))).alias("target")).groupBy("target").agg(F.count("*").alias("n")).orderBy("target")


@query("repo_links", f"SELECT DISTINCT regexp_replace(target, '[#?].*$', '') AS target FROM ({_LINK_SQL}) q WHERE regexp_replace(target, '[#?].*$', '') <> '' AND NOT starts_with(target, '//') AND NOT regexp_matches(target, '^[A-Za-z][-+.0-9A-Za-z]*:')")
def _(f: Facts) -> DataFrame:
    found = f.documents.select(F.explode(S.links(F.expr(_DOC))).alias("target")).where(S.is_repo_link(F.col("target")))
    return found.select(F.regexp_replace("target", r"[#?].*$", "").alias("target")).distinct()


_LOG = "'@' || CAST(1700000000 + user_id AS STRING) || ' author' || CAST(user_id % 7 AS STRING) || chr(10) || CAST(event_id % 50 AS STRING) || chr(9) || CASE WHEN event_id % 6 = 0 THEN '-' ELSE CAST(event_id % 9 AS STRING) END || chr(9) || event_type || '/a.ts' || chr(10) || chr(10) || '3' || chr(9) || '1' || chr(9) || CASE WHEN event_id % 5 = 0 THEN chr(34) || 'q.ts' || chr(34) ELSE 'b.ts' END"


@query("parse_gitlog", "SELECT event_id AS doc, event_type || '/a.ts' AS path, 1700000000 + user_id AS at, 'author' || CAST(user_id % 7 AS STRING) AS author, event_id % 50 AS added, CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id % 9 END AS deleted FROM events UNION ALL SELECT event_id, 'b.ts', 1700000000 + user_id, 'author' || CAST(user_id % 7 AS STRING), 3, 1 FROM events WHERE event_id % 5 <> 0")
def _(f: Facts) -> DataFrame:
    return S.git_log(S.lines_of(f.events.selectExpr("event_id", f"{_LOG} AS log"), "event_id", "log")).select("doc", "path", "at", "author", "added", "deleted")


@query("jsonl_permissive", "SELECT event_id AS doc, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_id % 4 <> 0")
def _(f: Facts) -> DataFrame:
    raw = f.events.select(F.col("event_id").alias("doc"), F.lit(0).alias("pos"), F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("line"))
    return S.json_rows(raw, "k long, _bad string").where("_bad IS NULL").select("doc", "k")


_DIFF = "'diff --git a/x b/x' || chr(10) || '--- a/x' || chr(10) || '+++ b/' || event_type || '.ts' || chr(10) || '@@ -1 +1 @@' || chr(10) || '+a' || chr(10) || '+b' || chr(10) || '-c' || chr(10) || '@@ -9 +9 @@' || chr(10) || ' d' || chr(10) || '-e' || chr(10) || 'diff --git a/y b/y' || chr(10) || '+++ b/y.ts' || chr(10) || '@@ -2 +2 @@' || repeat(chr(10) || '+z', CAST(event_id % 5 AS INT))"


@query("parse_diff", "SELECT event_id AS doc, CAST(1 AS BIGINT) AS file_no, event_type || '.ts' AS path, CAST(1 AS BIGINT) AS hunk, 2 AS added, 1 AS removed FROM events UNION ALL SELECT event_id, 1, event_type || '.ts', 2, 0, 1 FROM events UNION ALL SELECT event_id, 2, 'y.ts', 1, event_id % 5, 0 FROM events WHERE event_id % 5 > 0".replace("2 AS added, 1 AS removed", "CAST(2 AS BIGINT) AS added, CAST(1 AS BIGINT) AS removed"))
def _(f: Facts) -> DataFrame:
    return S.unified_diff(f.events.selectExpr("event_id", f"{_DIFF} AS diff"), "event_id", "diff")


@query("doc_sections")
def _(f: Facts) -> DataFrame:
    text = "'intro' || chr(10) || '# One' || chr(10) || text || chr(10) || '~~~~' || chr(10) || '# not a heading' || chr(10) || '~~~' || chr(10) || '~~~~~' || chr(10) || '## Two ##' || chr(10) || 'end'"
    return S.sections(S.lines_of(f.documents.selectExpr("doc_id", f"{text} AS md"), "doc_id", "md")).orderBy("doc", "section")


@query("resolve_relative", "SELECT file_no, CASE file_no % 4 WHEN 0 THEN 'x.ts' WHEN 1 THEN 'a/x.ts' WHEN 2 THEN '../x.ts' ELSE 'a/c' END AS path FROM file")
def _(f: Facts) -> DataFrame:
    raw = f.file.selectExpr("file_no", "CASE file_no % 4 WHEN 0 THEN './a/../x.ts' WHEN 1 THEN 'a/b/.././x.ts' WHEN 2 THEN 'a/../../x.ts' ELSE 'a//b/../c/.' END AS path")
    return raw.select("file_no", S.resolve(F.col("path")).alias("path"))


@query("package_of", "SELECT specifier, CASE WHEN regexp_matches(specifier, '^(\\.|/|~|#|@/)') THEN NULL WHEN starts_with(specifier, '@') THEN regexp_extract(specifier, '^(@[^/]+/[^/]+)', 1) ELSE regexp_extract(specifier, '^([^/]+)', 1) END AS package, count(*) AS n FROM unresolved_specifier GROUP BY specifier".replace("\\\\", "\\"))
def _(f: Facts) -> DataFrame:
    return f.unresolved_specifier.groupBy("specifier").agg(F.count("*").alias("n")).withColumn("package", specifiers.package_of(F.col("specifier"))).orderBy("specifier")


_CAUSE = "WITH s AS (SELECT DISTINCT specifier, CASE WHEN regexp_matches(specifier, '^(\\.|/|~|#|@/)') THEN NULL WHEN starts_with(specifier, '@') THEN regexp_extract(specifier, '^(@[^/]+/[^/]+)', 1) ELSE regexp_extract(specifier, '^([^/]+)', 1) END AS package FROM unresolved_specifier), i AS (SELECT DISTINCT 'lib' || CAST(n_nationkey AS STRING) AS package, n_nationkey % 2 = 0 AS subpath FROM nation), d AS (SELECT DISTINCT '@scope/pkg' || CAST(n_nationkey AS STRING) AS package FROM nation) SELECT specifier, CASE WHEN regexp_matches(specifier, '^\\.') THEN CASE WHEN specifier IN ('./s1', './s2') THEN 'unmapped' ELSE 'broken' END WHEN i.package IS NOT NULL THEN CASE WHEN subpath THEN 'unmapped' ELSE 'missing-generated' END WHEN d.package IS NOT NULL THEN 'unprepared' ELSE 'broken' END AS cause FROM s LEFT JOIN i ON i.package = s.package LEFT JOIN d ON d.package = s.package".replace("\\\\", "\\")


@query("specifier_cause", _CAUSE)
def _(f: Facts) -> DataFrame:
    asked = f.unresolved_specifier.select("specifier").distinct()
    installed = f.nation.selectExpr("'lib' || CAST(n_nationkey AS STRING) AS package", "n_nationkey % 2 = 0 AS subpath")
    declared = f.nation.selectExpr("'@scope/pkg' || CAST(n_nationkey AS STRING) AS package")
    on_disk = f.nation.where("n_nationkey IN (1, 2)").selectExpr("'./s' || CAST(n_nationkey AS STRING) AS specifier")
    return specifiers.causes(asked, on_disk, installed, declared).orderBy("specifier")


@query("glob_classify", f"SELECT path, regexp_matches(path, '{path_glob('r1/**/s*.ts')}') AS a, regexp_matches(path, '{path_glob('*/n?/*')}') AS b, regexp_matches(path, '{path_glob('**/n1*/**')}') AS c FROM file")
def _(f: Facts) -> DataFrame:
    return f.file.select("path", *[F.col("path").rlike(path_glob(p)).alias(n) for n, p in (("a", "r1/**/s*.ts"), ("b", "*/n?/*"), ("c", "**/n1*/**"))]).orderBy("path")


_LINES = "SELECT doc_id, p, l FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p, unnest(string_split(text, chr(10))) AS l FROM documents) q WHERE length(l) >= 20"


@query("duplicated_lines", f"WITH l AS ({_LINES}), g AS (SELECT md5(l) AS h FROM l GROUP BY 1 HAVING count(DISTINCT doc_id) > 1) SELECT doc_id, count(*) AS lines FROM l WHERE md5(l) IN (SELECT h FROM g) GROUP BY doc_id")
def _(f: Facts) -> DataFrame:
    return atlas.duplicated(atlas.clone_groups(S.lines_of(f.documents, "doc_id", "text"))).select(F.col("doc").alias("doc_id"), "lines").orderBy("doc_id")


@query("clone_links", f"WITH l AS ({_LINES}), g AS (SELECT md5(l) AS h, doc_id FROM l GROUP BY 1, 2), c AS (SELECT h, doc_id AS a, lead(doc_id) OVER (PARTITION BY h ORDER BY doc_id) AS b FROM g) SELECT a, b, count(*) AS lines FROM c WHERE b IS NOT NULL GROUP BY a, b ORDER BY lines DESC, a, b LIMIT 20000")
def _(f: Facts) -> DataFrame:
    return atlas.clone_links(atlas.clone_groups(S.lines_of(f.documents, "doc_id", "text")), 20_000)


@query("bash_paths", "SELECT file_no, CASE file_no % 3 WHEN 0 THEN 'src/a.ts,b.mjs' WHEN 1 THEN '' ELSE path END AS paths FROM file")
def _(f: Facts) -> DataFrame:
    raw = f.file.selectExpr("file_no", "CASE file_no % 3 WHEN 0 THEN 'cat src/a.ts|grep \"x\" <b.mjs; ls c.md' WHEN 1 THEN 'ls x.ts && node y.js' ELSE 'head -3 ' || path END AS command")
    return raw.select("file_no", F.array_join(S.command_paths(F.col("command")), ",").alias("paths"))


@query("names_symbol", "SELECT count(*) FILTER (WHERE regexp_matches(' ' || l, '(^|[^A-Za-z0-9_$])the($|[^A-Za-z0-9_$])')) AS named, count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) q")
def _(f: Facts) -> DataFrame:
    lines = S.lines_of(f.documents, "doc_id", "text")
    return lines.agg(F.count_if(S.names_symbol(F.concat(F.lit(" "), "line"), "the")).alias("named"), F.count("*").alias("lines"))


@query("stream_tally", "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'assistant') AS steps, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS output_chars, CAST(sum(len([x FOR x IN string_split(text, chr(10)) IF trim(x) <> ''])) AS BIGINT) AS lines, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY conv_id")
def _(f: Facts) -> DataFrame:
    return S.transcripts(f.conversations).withColumn("last_turn", F.col("last_turn").cast("long")).orderBy("conv_id")


@query("result_sizes", "SELECT doc_id, length(text) AS chars, CAST(len([x FOR x IN string_split(text, chr(10)) IF trim(x) <> '']) AS BIGINT) AS lines FROM documents")
def _(f: Facts) -> DataFrame:
    return f.documents.select("doc_id", F.length("text").cast("long").alias("chars"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("lines"))
