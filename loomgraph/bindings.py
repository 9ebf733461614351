"""Fact relations bound to the star-schema tables.

Each binding is one SQL query that Spark and other engines read alike, so that
queries over it can be held against an independent engine. ``facts`` gives them
as DataFrames; the same operators take facts loaded from files instead
(``loomgraph.facts``).

Relations in ``BUILT`` take joins and shuffles of the largest tables. They are
derived once per session and state of the tables, written to the shared folder,
and read from there by every query, as an index is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from loomgraph.session import parts, scratch, sent, small_splits, spread

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()

KINDS = ("function", "class", "interface", "typeAlias", "enum", "variable", "method", "namespace")
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_KIND = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"

#: Relations that are written once and read again.
BUILT = ("file", "symbol", "call_edge", "reference_edge", "file_import", "claim")

#: Later relations may use earlier ones.
BINDINGS: dict[str, str] = {
    "project": "SELECT 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/tsconfig.json' AS config_path, 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) AS dir, CASE WHEN n_nationkey % 4 = 1 THEN 'syntactic' ELSE 'typed' END AS fidelity, CASE WHEN n_nationkey % 8 = 1 THEN 'unprepared' WHEN n_nationkey % 8 = 5 THEN 'missing-generated' END AS cause, md5(n_name) AS fingerprint, n_nationkey % 3 = 0 AS postinstall, n_nationkey AS n_key FROM nation",
    "file": "SELECT s_suppkey AS file_no, 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/s' || CAST(s_suppkey AS STRING) || '.ts' AS path, 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/tsconfig.json' AS project, md5('h' || CAST(CAST(floor(abs(s_acctbal) * 100) AS BIGINT) AS STRING)) AS content_hash, CAST(floor(abs(s_acctbal)) AS BIGINT) AS size, CAST(s_suppkey * 1000 AS DOUBLE) AS mtime_ms, md5(n_name || CAST(s_suppkey % 5 AS STRING)) AS export_shape_hash, s_nationkey AS n_key FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "symbol": f"SELECT 'p' || CAST(p_partkey AS STRING) AS id, path, p_name AS name, p_name || '.' || p_brand AS qualified, {_KIND} AS kind, p_partkey * 10 AS start, CAST(p_size AS INT) AS line, p_size > 10 AS durable, p_partkey % 8 IN (0, 1, 6) AS callable, CAST(count(*) OVER (PARTITION BY path, p_name) - 1 AS BIGINT) AS collisions FROM part CROSS JOIN (SELECT count(*) AS n_sup FROM supplier) AS c JOIN file ON file_no = p_partkey % n_sup",
    "declaration": "SELECT path, start + 5 AS start, id FROM symbol WHERE collisions > 0",
    "site": "SELECT l_partkey AS a, lead(l_partkey) OVER w AS b, l_suppkey AS f, lead(l_suppkey) OVER w AS g, l_linenumber, l_quantity, l_discount, l_returnflag, l_linestatus FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)",
    "call_edge": "SELECT 'p' || CAST(a AS STRING) AS from_id, 'p' || CAST(b AS STRING) AS to_id, CASE WHEN l_linestatus = 'F' THEN 'symbol' ELSE 'variable' END AS attribution, path, CAST(l_linenumber AS INT) AS line, CASE l_returnflag WHEN 'A' THEN 'deterministic' WHEN 'N' THEN 'syntactic' ELSE 'inferred' END AS provenance, CASE WHEN l_discount > 0.05 THEN 'checker' ELSE 'alias' END AS derivation, l_quantity AS quantity, a AS from_no, b AS to_no FROM site JOIN file ON file_no = f WHERE b IS NOT NULL",
    "sparse_edge": "SELECT DISTINCT from_id, to_id FROM call_edge WHERE quantity >= 45",
    "reference_edge": "SELECT 'p' || CAST(o_custkey % n_part AS STRING) AS from_id, 'p' || CAST(o_orderkey % n_part AS STRING) AS to_id, CASE o_orderkey % 4 WHEN 0 THEN 'references' WHEN 1 THEN 'extends' WHEN 2 THEN 'implements' ELSE 'typeReferences' END AS kind, path, CAST(o_orderkey % 100 AS INT) AS line, CASE WHEN o_orderkey % 3 = 0 THEN 'syntactic' ELSE 'deterministic' END AS provenance, 'heritage-clause' AS derivation FROM orders CROSS JOIN (SELECT count(*) AS n_sup FROM supplier) AS c CROSS JOIN (SELECT count(*) AS n_part FROM part) AS d JOIN file ON file_no = o_orderkey % n_sup",
    "file_import": "SELECT x.path AS from_path, './s' || CAST(g AS STRING) AS specifier, max(CASE WHEN l_discount = 0 THEN NULL ELSE y.path END) AS to_path, count(*) AS n FROM site JOIN file x ON x.file_no = f JOIN file y ON y.file_no = g GROUP BY x.path, g",
    "file_project": "SELECT path, project, TRUE AS canonical, n_key FROM file UNION ALL SELECT path, config_path, FALSE, file.n_key FROM file JOIN project ON project.n_key = (file.n_key + 1) % 25 WHERE file_no % 3 = 0",
    "label": " UNION ALL ".join(
        f"SELECT path AS node, '{axis}' AS axis, '{value}' AS value, '{prov}' AS provenance, '{deriv}' AS derivation FROM file WHERE {where}"
        for axis, value, prov, deriv, where in (
            ("role", "source", "inferred", "default", "TRUE"), ("authorship", "authored", "inferred", "default", "TRUE"), ("role", "test", "inferred", "path-convention", "n_key % 5 = 0"), ("authorship", "generated", "inferred", "codegen-path", "file_no % 7 = 0"),
            ("authorship", "generated", "deterministic", "generated-header", "file_no % 11 = 0"), ("role", "config", "deterministic", "user-config", "file_no % 13 = 0"), ("authorship", "generated", "deterministic", "git-untracked", "file_no % 17 = 0"), ("authorship", "authored", "deterministic", "user-config", "file_no % 14 = 0"),
        )
    ),
    "unresolved_call": f"SELECT path, CAST(event_id % 200 AS INT) AS line, CASE {_K} % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'unresolvable' ELSE 'dynamic' END AS cause, CASE WHEN {_K} % 5 > 0 THEN 'n' || CAST({_K} AS STRING) END AS name FROM events CROSS JOIN (SELECT count(*) AS n_sup FROM supplier) AS c JOIN file ON file_no = user_id % n_sup WHERE event_type = 'error'",
    "unresolved_specifier": f"SELECT path, project, CASE {_K} % 3 WHEN 0 THEN './gone' WHEN 1 THEN '@scope/pkg' || CAST({_K} AS STRING) || '/sub' ELSE 'lib' || CAST({_K} AS STRING) END AS specifier, CAST(event_id % 200 AS INT) AS line, CASE {_K} % 4 WHEN 0 THEN 'unprepared' WHEN 1 THEN 'missing-generated' WHEN 2 THEN 'unmapped' ELSE 'broken' END AS cause FROM events CROSS JOIN (SELECT count(*) AS n_sup FROM supplier) AS c JOIN file ON file_no = user_id % n_sup WHERE event_type = 'view'",
    "snapshot_base": "SELECT 'o/' || CAST(o_orderkey AS STRING) || '.ts' AS path, md5(o_orderstatus) AS content_hash, o_custkey AS size, CAST(o_orderkey AS DOUBLE) AS mtime_ms, o_custkey % 25 AS n_key FROM orders WHERE o_orderkey % 10 <> 0",
    "snapshot_head": "SELECT 'o/' || CAST(o_orderkey AS STRING) || '.ts' AS path, md5(o_orderstatus || CASE WHEN o_custkey % 7 = 0 THEN 'x' ELSE '' END) AS content_hash, o_custkey + CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS size, CAST(o_orderkey + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS mtime_ms, o_custkey % 25 AS n_key FROM orders WHERE o_orderkey % 9 <> 0",
    "churn": f"SELECT event_id, event_type || '/' || CAST({_K} AS STRING) || '.ts' AS path, user_id AS author, CAST(ts AS DATE) AS day, ts, CAST(event_id % 50 AS BIGINT) AS added, CAST(event_id % 20 AS BIGINT) AS deleted, {_K} AS k FROM events",
    "frame": "SELECT day, path, max(added) AS calls_in, max(deleted) AS calls_out, count(*) AS unresolved FROM churn GROUP BY day, path",
    "run": "SELECT l_orderkey AS run_id, l_suppkey AS case_id, l_returnflag AS arm, CAST(l_linenumber AS INT) AS replicate, l_quantity AS tokens, l_extendedprice AS cost, l_tax AS share, l_discount > 0.08 AS invalid, CASE WHEN l_discount > 0.09 THEN 'no-diff' WHEN l_discount > 0.08 THEN 'timed-out' END AS reason, CASE l_suppkey % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' END AS level, CASE WHEN l_tax < 0.03 THEN 'incorrect' WHEN l_tax < 0.06 THEN 'partial' ELSE 'correct' END AS grade, CASE WHEN l_linestatus = 'F' THEN l_returnflag = 'A' END AS took_up, 'j' || CAST(l_partkey % 50 AS STRING) AS judgement, l_partkey FROM lineitem",
    "claim": "SELECT p_partkey AS claim_no, 'doc' || CAST(p_partkey % 17 AS STRING) AS doc, CAST(p_partkey % 5 AS INT) AS section, CASE p_partkey % 16 WHEN 0 THEN 'exists(p' || k || ')' WHEN 1 THEN '!exists(gone' || k || ')' WHEN 2 THEN 'calls(p' || k || ', p' || t || ')' WHEN 3 THEN '!calls(p' || k || ', p' || t || ')' WHEN 4 THEN 'calls(p' || k || ', p' || CAST(p_partkey + 1 AS STRING) || ')' WHEN 5 THEN '! calls(p' || k || ', p' || CAST(p_partkey + 1 AS STRING) || ')' WHEN 6 THEN 'extends(p' || k || ', p' || t || ')' WHEN 7 THEN 'imports(p' || k || ', p' || t || ')' WHEN 8 THEN 'hasLabel(p' || k || ', role, test)' WHEN 9 THEN 'onlyCalledBy(p' || k || ', r1/)' WHEN 10 THEN 'callers(p' || k || ') == ' || CAST(p_partkey % 30 AS STRING) WHEN 11 THEN 'callers(p' || k || ') == ' || c WHEN 12 THEN 'usesType(p' || k || ', gone1)' WHEN 13 THEN CASE WHEN p_partkey % 3 = 0 THEN 'exports(p' || k || ')' WHEN p_partkey % 3 = 1 THEN 'likes(p' || k || ')' ELSE 'not a claim' END WHEN 14 THEN CASE WHEN p_partkey % 3 = 0 THEN 'calls(p' || k || ')' WHEN p_partkey % 3 = 1 THEN 'callers(p' || k || ') == many' ELSE 'hasLabel(p' || k || ', colour, red)' END ELSE 'exists(gone' || k || ')' END AS text FROM (SELECT p_partkey, CAST(p_partkey AS STRING) AS k, CAST(coalesce(to_no, 0) AS STRING) AS t, CAST(coalesce(n_from, 0) AS STRING) AS c FROM part LEFT JOIN (SELECT from_no AS key_a, min(to_no) AS to_no FROM call_edge GROUP BY from_no) u ON key_a = p_partkey LEFT JOIN (SELECT to_no AS key_b, count(DISTINCT from_id) AS n_from FROM call_edge GROUP BY to_no) v ON key_b = p_partkey) z",
}

#: The same relation with less to shuffle, where each file number and each path occurs once: counted by numbers, named after it.
_NUMBERED_IMPORT = "SELECT x.path AS from_path, './s' || CAST(g AS STRING) AS specifier, CASE WHEN kept THEN y.path END AS to_path, n FROM (SELECT f, g, max(l_discount IS NULL OR l_discount <> 0) AS kept, count(*) AS n FROM (SELECT /*+ REPARTITION({n}, f, g) */ f, g, l_discount FROM site WHERE f IS NOT NULL AND g IS NOT NULL) r GROUP BY f, g) s JOIN file x ON x.file_no = f JOIN file y ON y.file_no = g"


def closure(names: list[str]) -> list[str]:
    """Bindings that the given ones need, in order."""
    import re

    need: set[str] = set()

    def visit(name: str) -> None:
        if name in BINDINGS and name not in need:
            need.add(name)
            for other in BINDINGS:
                if other != name and re.search(rf"\b{other}\b", BINDINGS[name]):
                    visit(other)

    for n in names:
        visit(n)
    return [n for n in BINDINGS if n in need]


def with_bindings(sql: str) -> str:
    """An SQL query preceded by the bindings that it mentions."""
    import re

    used = [n for n in BINDINGS if re.search(rf"\b{n}\b", sql)]
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in closure(used))
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if recursive or body.upper().startswith("WITH "):
        body = ", " + body[len("WITH RECURSIVE") if recursive else len("WITH") :].strip() if ctes else body
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body}" if ctes else body
    return f"WITH {ctes}\n{body}" if ctes else body


_WHERE: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def _state(spark: SparkSession, folder: str) -> str:
    """A folder's name with the sizes and times of what lies in it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    return folder + "|" + "|".join(sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in found))


class Facts:
    """Bound relations of one folder of tables, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BINDINGS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.table(name) if name in TABLES else self._built(name) if name in BUILT else self._bound(name)
        return self._made[name]

    def _built(self, name: str) -> DataFrame:
        sql = BINDINGS[name]
        if name == "file_import":
            n, numbers, paths = self.file.selectExpr("count(*)", "count(DISTINCT file_no)", "count(DISTINCT path)").first()
            sql = _NUMBERED_IMPORT.replace("{n}", str(parts(self.lineitem))) if n == numbers == paths else sql
        return self.once(name, lambda: self._bound(name, sql))

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, written when it is first asked for in this state of the tables."""
        key = (self.spark.sparkContext.applicationId, _state(self.spark, self.sf_dir), name)
        if key not in _WHERE:
            made, at = make(), scratch(self.spark, f"facts-{name}")
            with small_splits(self.spark):
                made.write.parquet(at)
            _WHERE[key] = at, made.schema
        at, schema = _WHERE[key]
        return self.spark.read.schema(schema).parquet(at)

    def _bound(self, name: str, sql: str | None = None) -> DataFrame:
        import re

        sql = sql or BINDINGS[name]
        used = {o: getattr(self, o) for o in [*BINDINGS, *TABLES] if o != name and re.search(rf"\b{o}\b", sql)}
        if name in ("call_edge", "reference_edge", "file_import"):
            used["file"] = sent(used["file"].select("file_no", "path"))
        if name == "site":
            used["lineitem"] = spread(used["lineitem"], "l_orderkey")
        # Inputs go by argument, not by temporary views, so that two folders can be open at once.
        for o in used:
            sql = re.sub(rf"\b(FROM|JOIN) {o}\b(?! AS)(?= [xy]\b)", rf"\1 {{{o}}}", sql)
            sql = re.sub(rf"\b(FROM|JOIN) {o}\b(?! [xy]\b)", rf"\1 {{{o}}} AS {o}", sql)
        return self.spark.sql(sql, **used)

    @cached_property
    def n_files(self) -> DataFrame:
        return self.supplier.selectExpr("count(*) AS n")


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    return Facts(spark, sf_dir)
