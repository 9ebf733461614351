"""Claims: parsing, evaluation, verdicts, drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.bindings import Facts
from loomgraph.operators import claims as C
from loomgraph.plans.labels import _EFFECTIVE
from loomgraph.plans.registry import query

_P = "(SELECT claim_no, doc, section, text, regexp_extract(text, '{s}', 1) = '!' AS negated, regexp_extract(text, '{s}', 2) AS predicate, [trim(x) FOR x IN string_split(regexp_extract(text, '{s}', 3), ',')] AS args, trim(regexp_extract(text, '{s}', 4)) AS tail FROM claim)".replace("{s}", C.SHAPE)
_ARITY = "CASE " + " ".join(f"WHEN predicate = '{k}' THEN {v}" for k, v in C.ARITY.items()) + " END"
_FAULT = (
    f"CASE WHEN predicate = '' THEN 'unparseable' WHEN predicate IN ('exports', 'dependsOn') THEN 'no-backend' WHEN {_ARITY} IS NULL THEN 'unknown-predicate' WHEN len(args) <> {_ARITY} THEN 'arity' "
    "WHEN predicate IN ('callers', 'implementations') AND NOT regexp_matches(tail, '^==\\s*[0-9]+$') THEN 'count-invalid' WHEN predicate NOT IN ('callers', 'implementations') AND tail <> '' THEN 'unparseable' WHEN predicate = 'onlyCalledBy' AND negated THEN 'no-backend' "
    "WHEN predicate = 'hasLabel' AND args[2] || '=' || args[3] NOT IN ('role=source', 'role=test', 'role=config', 'authorship=authored', 'authorship=generated') THEN 'label-invalid' END"
)
_PARSED = f"SELECT claim_no, text, negated, predicate, array_to_string(args, '|') AS args, CASE WHEN predicate IN ('callers', 'implementations') AND regexp_matches(tail, '^==\\s*[0-9]+$') THEN CAST(regexp_extract(tail, '([0-9]+)', 1) AS BIGINT) END AS n, {_FAULT} AS fault FROM {_P} p"

_EVAL = f"""WITH p AS (SELECT *, args[1] AS a, args[2] AS b, args[3] AS c, CASE WHEN predicate IN ('callers', 'implementations') AND regexp_matches(tail, '^==\\s*[0-9]+$') THEN CAST(regexp_extract(tail, '([0-9]+)', 1) AS BIGINT) END AS n, {_FAULT} AS f0,
  predicate IN ('calls', 'imports', 'references', 'extends', 'implements', 'usesType') AS second, predicate IN ('callers', 'implementations') AS whole FROM {_P} p0),
dark AS (SELECT path, n_key % 4 = 1 AS syntactic, path IN (SELECT path FROM unresolved_specifier WHERE cause = 'broken') AS broken FROM file),
q AS (SELECT p.*, x.path AS path_a, y.path AS path_b, x.durable AS da, y.durable AS db, coalesce(dx.syntactic, FALSE) AS sa, coalesce(dy.syntactic, FALSE) AS sb, coalesce(dx.broken, FALSE) AS ba, coalesce(dy.broken, FALSE) AS bb
  FROM p LEFT JOIN symbol x ON x.id = a LEFT JOIN symbol y ON y.id = b LEFT JOIN dark dx ON dx.path = x.path LEFT JOIN dark dy ON dy.path = y.path),
o AS (SELECT *, CASE predicate WHEN 'callers' THEN (SELECT count(DISTINCT from_id) FROM call_edge WHERE to_id = a) WHEN 'implementations' THEN (SELECT count(DISTINCT from_id) FROM reference_edge WHERE to_id = a AND kind = 'implements') WHEN 'onlyCalledBy' THEN (SELECT count(*) FROM call_edge WHERE to_id = a AND NOT starts_with(path, regexp_replace(b, '/$', '') || '/')) END AS seen FROM q),
r AS (SELECT *, CASE WHEN predicate = 'exists' THEN path_a IS NOT NULL WHEN predicate = 'calls' THEN EXISTS (SELECT 1 FROM call_edge WHERE from_id = a AND to_id = b) WHEN predicate = 'imports' THEN EXISTS (SELECT 1 FROM file_import WHERE from_path = path_a AND to_path = path_b)
  WHEN predicate IN ('references', 'extends', 'implements', 'usesType') THEN EXISTS (SELECT 1 FROM reference_edge WHERE from_id = a AND to_id = b AND kind = CASE predicate WHEN 'usesType' THEN 'typeReferences' ELSE predicate END)
  WHEN predicate = 'hasLabel' THEN EXISTS (SELECT 1 FROM ({_EFFECTIVE}) e WHERE node = path_a AND axis = b AND value = c) WHEN predicate = 'onlyCalledBy' THEN seen = 0 ELSE seen = n END AS present,
  CASE WHEN predicate <> 'hasLabel' THEN CASE WHEN sa OR (second AND sb) THEN 'syntactic' WHEN ba OR (second AND bb) THEN 'unresolved-specifier' END END AS doubt,
  CASE WHEN predicate = 'exists' THEN path_a IS NULL AND NOT negated ELSE path_a IS NULL OR (second AND path_b IS NULL) END AS lost,
  coalesce(f0, CASE WHEN da = FALSE OR (second AND db = FALSE) THEN 'local-subject' END) AS fault FROM o),
v AS (SELECT *, doubt IS NOT NULL AND (whole OR NOT present) AS doubted, present <> (negated AND NOT whole) AS holds FROM r)
SELECT claim_no, doc, section, text, predicate, negated, CASE WHEN fault IS NOT NULL THEN NULL WHEN lost OR doubted THEN 'unable-to-verify' WHEN holds THEN 'verified' ELSE 'contradicted' END AS verdict,
CASE WHEN fault IS NOT NULL THEN fault WHEN lost THEN 'unresolved' WHEN doubted THEN doubt WHEN holds THEN 'holds' WHEN whole THEN 'count-differs' ELSE 'falsified' END AS reason, CASE WHEN fault IS NULL THEN seen END AS observed, fault IS NOT NULL AS faulty FROM v"""


def _evaluated(f: Facts, *predicates: str) -> DataFrame:
    broken = f.unresolved_specifier.where("cause = 'broken'").select("path").distinct().withColumn("broken", F.lit(True))
    doubts = f.file.select("path", (F.col("n_key") % 4 == 1).alias("syntactic")).join(broken, "path", "left").fillna(False, ["broken"])
    return C.evaluate(f.claim, f.symbol, f.call_edge, f.reference_edge, f.file_import, f.label, doubts, predicates=predicates or None)


def _family(name: str, *predicates: str) -> None:
    listed = ", ".join(f"'{p}'" for p in predicates)
    query(name, f"SELECT claim_no, negated, verdict, reason, observed FROM ({_EVAL}) z WHERE predicate IN ({listed}) AND NOT faulty")(
        lambda f: _evaluated(f, *predicates).where(~F.col("faulty")).select("claim_no", "negated", "verdict", "reason", "observed").orderBy("claim_no")
    )


_family("claim_exists", "exists")
_family("claim_calls", "calls")
_family("claim_refs", "references", "extends", "implements", "usesType")
_family("claim_imports", "imports")
_family("claim_label", "hasLabel")
_family("claim_count", "callers", "implementations")


@query("claim_parse", _PARSED)
def _(f: Facts) -> DataFrame:
    p = f.claim.withColumn("p", C.parse(F.col("text")))
    return p.select("claim_no", "text", "p.negated", "p.predicate", F.when(F.col("p.predicate") == "", "").otherwise(F.array_join("p.args", "|")).alias("args"), F.col("p.count").alias("n"), "p.fault").orderBy("claim_no")


@query("claim_faults", f"SELECT reason, count(*) AS n FROM ({_EVAL}) z WHERE faulty GROUP BY reason")
def _(f: Facts) -> DataFrame:
    return _evaluated(f).where("faulty").groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


@query("claim_verdict", f"SELECT claim_no, text, verdict, reason FROM ({_EVAL}) z")
def _(f: Facts) -> DataFrame:
    return _evaluated(f).select("claim_no", "text", "verdict", "reason").orderBy("claim_no")


@query("verify", f"SELECT text, verdict, reason, observed FROM ({_EVAL}) z WHERE NOT faulty")
def _(f: Facts) -> DataFrame:
    return _evaluated(f).where("NOT faulty").select("text", "verdict", "reason", "observed").orderBy("text")


_SECTIONS = "SELECT 'doc' || CAST(n_nationkey AS STRING) AS doc, s AS section, CASE WHEN n_nationkey * s % 13 = 5 THEN 1 ELSE 0 END AS broken_links, n_nationkey * s % 3 AS links, (n_nationkey + s) % 4 = 0 AS touched FROM nation, (SELECT {series} AS s) t WHERE n_nationkey < 20"
_SECTION_SQL = f"WITH ev AS ({_EVAL}), sec AS ({_SECTIONS.format(series='unnest(range(0, 6))')}), k AS (SELECT doc, section, count(*) AS claims, count(*) FILTER (WHERE verdict = 'contradicted') AS bad, count(*) FILTER (WHERE verdict = 'unable-to-verify') AS unable FROM ev GROUP BY doc, section), sv AS (SELECT sec.doc, sec.section, coalesce(claims, 0) AS claims, CASE WHEN coalesce(claims, 0) = 0 AND links = 0 THEN NULL WHEN bad > 0 OR broken_links > 0 THEN 'contradicted' WHEN unable > 0 THEN 'unable-to-verify' WHEN touched THEN 'potentially-stale' ELSE 'verified' END AS verdict FROM sec LEFT JOIN k ON k.doc = sec.doc AND k.section = sec.section)"


def _sections(f: Facts) -> DataFrame:
    listed = f.nation.where("n_nationkey < 20").select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("section"))
    sections = listed.selectExpr("'doc' || CAST(n_nationkey AS STRING) AS doc", "section", "CASE WHEN n_nationkey * section % 13 = 5 THEN 1 ELSE 0 END AS broken_links", "n_nationkey * section % 3 AS links", "(n_nationkey + section) % 4 = 0 AS touched")
    return C.section_verdicts(_evaluated(f).join(f.claim.select("claim_no", "doc", "section"), "claim_no"), sections)


@query("doc_verdict", _SECTION_SQL + " SELECT doc, CASE min(CASE verdict WHEN 'contradicted' THEN 1 WHEN 'unable-to-verify' THEN 2 WHEN 'potentially-stale' THEN 3 WHEN 'verified' THEN 4 END) WHEN 1 THEN 'contradicted' WHEN 2 THEN 'unable-to-verify' WHEN 3 THEN 'potentially-stale' WHEN 4 THEN 'verified' END AS verdict, count(*) FILTER (WHERE claims > 0) AS covered, count(*) AS sections FROM sv GROUP BY doc")
def _(f: Facts) -> DataFrame:
    return C.document_verdicts(_sections(f)).orderBy("doc")


@query("claim_coverage", _SECTION_SQL + " SELECT count(*) FILTER (WHERE claims > 0) AS covered, count(*) AS sections, round(count(*) FILTER (WHERE claims > 0) / count(*), 6) AS share FROM sv")
def _(f: Facts) -> DataFrame:
    return _sections(f).agg(F.count_if(F.col("claims") > 0).alias("covered"), F.count("*").alias("sections"), F.round(F.count_if(F.col("claims") > 0) / F.count("*"), 6).alias("share"))


@query("docs_failing", _SECTION_SQL + " SELECT count(DISTINCT doc) FILTER (WHERE verdict = 'contradicted') AS contradicted, count(DISTINCT doc) FILTER (WHERE verdict IN ('contradicted', 'potentially-stale')) AS failing, (SELECT count(DISTINCT doc) FROM ev WHERE faulty) AS faulty FROM sv")
def _(f: Facts) -> DataFrame:
    docs = _sections(f).groupBy("doc").agg(F.max(F.col("verdict") == "contradicted").alias("c"), F.max(F.col("verdict").isin("contradicted", "potentially-stale")).alias("s"))
    faulty = _evaluated(f).where("faulty").join(f.claim.select("claim_no", "doc"), "claim_no").agg(F.count_distinct("doc").alias("faulty"))
    return docs.agg(F.count_if("c").alias("contradicted"), F.count_if("s").alias("failing")).join(F.broadcast(faulty), how="inner")


_FACT_CLAIMS = "SELECT id AS owner, 'exists(' || id || ')' AS claim FROM symbol WHERE durable UNION SELECT from_id, 'calls(' || from_id || ', ' || to_id || ')' FROM call_edge JOIN symbol x ON x.id = from_id AND x.durable JOIN symbol y ON y.id = to_id AND y.durable WHERE attribution <> 'file' UNION SELECT from_id, CASE r.kind WHEN 'typeReferences' THEN 'usesType' ELSE r.kind END || '(' || from_id || ', ' || to_id || ')' FROM reference_edge r JOIN symbol x ON x.id = from_id AND x.durable JOIN symbol y ON y.id = to_id AND y.durable UNION SELECT from_path, 'imports(' || from_path || ', ' || to_path || ')' FROM file_import WHERE to_path IS NOT NULL"


@query("claims_for", _FACT_CLAIMS)
def _(f: Facts) -> DataFrame:
    return C.from_facts(f.symbol, f.call_edge, f.reference_edge, f.file_import)


@query("draft_candidates", f"SELECT claim, min(owner) AS section FROM ({_FACT_CLAIMS}) q WHERE owner IN (SELECT id FROM symbol WHERE name = (SELECT p_name FROM part WHERE p_partkey = 11)) GROUP BY claim")
def _(f: Facts) -> DataFrame:
    name = f.part.where("p_partkey = 11").select(F.col("p_name").alias("name"))
    owners = f.symbol.join(F.broadcast(name), "name", "left_semi").select(F.col("id").alias("owner"))
    return C.from_facts(f.symbol, f.call_edge, f.reference_edge, f.file_import, owners).groupBy("claim").agg(F.min("owner").alias("section"))


@query(
    "draft_markdown",
    f"""SELECT owner, path, count(*) AS claims, '## ' || name || chr(10) || chr(10) || 'Declared in `' || path || '`.' || chr(10) || chr(10) || string_agg('<!-- claim: ' || claim || ' -->', chr(10) ORDER BY claim) || chr(10) AS markdown
FROM ({_FACT_CLAIMS}) q JOIN symbol ON id = owner AND symbol.kind = 'class' GROUP BY owner, path, name""",
)
def _(f: Facts) -> DataFrame:
    owners = f.symbol.where("kind = 'class'").select(F.col("id").alias("owner"), "name", "path")
    facts = C.from_facts(f.symbol, f.call_edge, f.reference_edge, f.file_import, owners).join(owners, "owner")
    lines = facts.groupBy("owner", "name", "path").agg(F.array_sort(F.collect_list("claim")).alias("claims"))
    body = F.concat(F.lit("## "), "name", F.lit("\n\nDeclared in `"), "path", F.lit("`.\n\n"), F.array_join(F.transform("claims", lambda c: F.concat(F.lit("<!-- claim: "), c, F.lit(" -->"))), "\n"), F.lit("\n"))
    return lines.select("owner", "path", F.size("claims").cast("long").alias("claims"), body.alias("markdown")).orderBy("path", "owner")


@query("claim_paths", "SELECT path, array_to_string(list_sort(list_distinct([n FOR n IN [regexp_replace(trim(x), '#.*$', '') FOR x IN string_split(regexp_extract(t, '\\(([^)]*)\\)', 1), ',')] IF contains(n, '/') OR regexp_matches(n, '\\.[cm]?tsx?$')])), ',') AS paths FROM (SELECT path, CASE file_no % 3 WHEN 0 THEN 'imports(' || path || '#x, ' || project || ')' WHEN 1 THEN 'calls(a.b, c.ts#d)' ELSE 'exists(Foo)' END AS t FROM file) q".replace("\\\\", "\\"))
def _(f: Facts) -> DataFrame:
    texts = f.file.selectExpr("path", "CASE file_no % 3 WHEN 0 THEN 'imports(' || path || '#x, ' || project || ')' WHEN 1 THEN 'calls(a.b, c.ts#d)' ELSE 'exists(Foo)' END AS t")
    return texts.select("path", F.array_join(F.array_sort(C.claim_paths(F.col("t"))), ",").alias("paths"))
