"""Drift, diffs, waves, upserts, baselines, continuations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.bindings import Facts
from loomgraph.operators import maintain
from loomgraph.plans.registry import query

_DRIFT = "SELECT path, CASE WHEN h.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN CASE WHEN s.p IS NULL THEN 'added' END WHEN NOT ((b.size = h.size AND b.mtime_ms = h.mtime_ms) OR b.content_hash = h.content_hash) THEN 'changed' END AS state FROM snapshot_base b FULL OUTER JOIN snapshot_head h USING (path) LEFT JOIN (SELECT path AS p FROM snapshot_head WHERE n_key = 3) s ON s.p = path"


@query("drift", f"SELECT * FROM ({_DRIFT}) q WHERE state IS NOT NULL")
def _(f: Facts) -> DataFrame:
    return maintain.drift(f.snapshot_base, f.snapshot_head, f.snapshot_head.where("n_key = 3").select("path"))


_DIFF = "SELECT path, CASE WHEN b.content_hash IS NULL THEN 'added' WHEN h.content_hash IS NULL THEN 'removed' WHEN b.content_hash <> h.content_hash THEN 'changed' END AS change, coalesce(h.n_key, b.n_key) AS n_key FROM snapshot_base b FULL OUTER JOIN snapshot_head h USING (path)"


@query("snapshot_diff", f"SELECT path, change FROM ({_DIFF}) q WHERE change IS NOT NULL")
def _(f: Facts) -> DataFrame:
    return maintain.snapshot_diff(f.snapshot_base, f.snapshot_head)


@query("snapshot_diff_fidelity", f"SELECT path, change, n_key % 4 = 1 AS excluded FROM ({_DIFF}) q WHERE change IS NOT NULL")
def _(f: Facts) -> DataFrame:
    owner = f.snapshot_head.select("path", "n_key").union(f.snapshot_base.join(f.snapshot_head.select("path"), "path", "left_anti").select("path", "n_key"))
    before = f.project.select(F.col("n_key").cast("long").alias("n_key"), F.lit("typed").alias("was"), "fidelity")
    diff = maintain.snapshot_diff(f.snapshot_base, f.snapshot_head)
    return diff.join(owner, "path").join(before, "n_key").select("path", "change", (F.col("was") != F.col("fidelity")).alias("excluded"))


@query("changed_paths", "SELECT path FROM snapshot_base WHERE n_key = 1 UNION SELECT path FROM snapshot_head WHERE n_key = 2 UNION SELECT path FROM snapshot_head WHERE size % 11 = 0")
def _(f: Facts) -> DataFrame:
    head = f.snapshot_head
    return f.snapshot_base.where("n_key = 1").select("path").union(head.where("n_key = 2").select("path")).union(head.where("size % 11 = 0").select("path")).distinct()


@query("upsert_by_file", "SELECT path, content_hash, size FROM snapshot_base WHERE path NOT IN (SELECT path FROM snapshot_head WHERE n_key < 5) UNION ALL SELECT path, content_hash, size FROM snapshot_head WHERE n_key < 5")
def _(f: Facts) -> DataFrame:
    keep = ["path", "content_hash", "size"]
    return maintain.upsert(f.snapshot_base.select(*keep), f.snapshot_head.where("n_key < 5").select(*keep))


@query("retire_files", "SELECT path, content_hash FROM snapshot_base WHERE path NOT IN (SELECT path FROM snapshot_head WHERE n_key < 5)")
def _(f: Facts) -> DataFrame:
    return maintain.retire(f.snapshot_base, f.snapshot_head.where("n_key < 5")).select("path", "content_hash")


@query("dedup_first", "SELECT path, author, event_id FROM (SELECT *, row_number() OVER (PARTITION BY path, author ORDER BY event_id) AS n FROM churn) q WHERE n = 1")
def _(f: Facts) -> DataFrame:
    return maintain.keep_first(f.churn, ["path", "author"], "event_id").select("path", "author", "event_id")


@query("dedup_last", "SELECT path, author, event_id FROM (SELECT *, row_number() OVER (PARTITION BY path, author ORDER BY event_id DESC) AS n FROM churn) q WHERE n = 1")
def _(f: Facts) -> DataFrame:
    return maintain.keep_last(f.churn, ["path", "author"], "event_id").select("path", "author", "event_id")


_PRINT = "SELECT project, sha256(string_agg(content_hash, chr(0) ORDER BY content_hash)) AS fingerprint FROM file GROUP BY project"


@query("fingerprint", _PRINT)
def _(f: Facts) -> DataFrame:
    return f.file.groupBy("project").agg(maintain.joined_hash(F.collect_list("content_hash"), "\0").alias("fingerprint")).orderBy("project")


@query("fingerprint_moved", "WITH a AS (SELECT n_key, sha256(string_agg(content_hash, '|' ORDER BY content_hash)) AS h FROM snapshot_base GROUP BY 1), b AS (SELECT n_key, sha256(string_agg(content_hash, '|' ORDER BY content_hash)) AS h FROM snapshot_head WHERE n_key <> 7 GROUP BY 1) SELECT a.n_key, a.h IS DISTINCT FROM b.h AS moved FROM a LEFT JOIN b ON b.n_key = a.n_key")
def _(f: Facts) -> DataFrame:
    prints = lambda df: df.groupBy("n_key").agg(maintain.joined_hash(F.collect_list("content_hash")).alias("h"))
    return prints(f.snapshot_base).join(prints(f.snapshot_head.where("n_key <> 7")).withColumnRenamed("h", "g"), "n_key", "left").select("n_key", (~F.col("h").eqNullSafe(F.col("g"))).alias("moved"))


@query("fidelity_of", "SELECT config_path, CASE WHEN postinstall THEN 'syntactic' WHEN n = 0 THEN 'syntactic' ELSE 'typed' END AS fidelity, CASE WHEN postinstall THEN 'unprepared' WHEN n = 0 THEN 'missing-generated' END AS cause FROM (SELECT config_path, postinstall, (SELECT count(*) FROM file WHERE file.n_key = project.n_key AND file_no % 2 = 0) AS n FROM project) q")
def _(f: Facts) -> DataFrame:
    globbed = f.file.where("file_no % 2 = 0").groupBy("n_key").agg(F.count("*").alias("n"))
    cause = F.when(F.col("postinstall"), "unprepared").when(F.coalesce("n", F.lit(0)) == 0, "missing-generated")
    return f.project.join(globbed, "n_key", "left").select("config_path", F.when(cause.isNull(), "typed").otherwise("syntactic").alias("fidelity"), cause.alias("cause")).orderBy("config_path")


_SEED = "SELECT path FROM file WHERE file_no % 40 = 3 UNION SELECT from_path FROM file_import WHERE to_path IN (SELECT path FROM file WHERE file_no = 7) UNION SELECT from_path FROM file_import WHERE to_path IS NULL AND specifier = './s9'"


@query("wave_seed", f"SELECT path FROM ({_SEED}) q WHERE path NOT IN (SELECT path FROM file WHERE file_no = 7)")
def _(f: Facts) -> DataFrame:
    changed = f.file.where("file_no % 40 = 3").select("path")
    gone = f.file.where("file_no = 7").select("path")
    users = f.file_import.join(gone.withColumnRenamed("path", "to_path"), "to_path", "left_semi").select("from_path")
    broken = f.file_import.where("to_path IS NULL AND specifier = './s9'").select("from_path")
    return changed.union(users).union(broken).distinct().join(gone, "path", "left_anti").orderBy("path")


_THIN = "(SELECT from_path, to_path FROM file_import WHERE to_path IS NOT NULL)"
_RESHAPED = "(SELECT path FROM file WHERE file_no % 3 <> 0)"


def _wave_sql(most: int) -> str:
    ctes = [f"t AS {_THIN}", f"s AS {_RESHAPED}", "v0 AS (SELECT path FROM file WHERE file_no % 40 = 3)"]
    for w in range(1, most + 1):
        before = " UNION ALL ".join(f"SELECT path FROM v{k}" for k in range(w))
        ctes.append(f"v{w} AS MATERIALIZED (SELECT DISTINCT from_path AS path FROM t WHERE to_path IN (SELECT path FROM v{w - 1}) AND to_path IN (SELECT path FROM s) AND from_path NOT IN ({before}))")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT path, {w} AS wave FROM v{w}" for w in range(most + 1))


@query("wave_frontier", _wave_sql(8))
def _(f: Facts) -> DataFrame:
    imports = f.file_import.where("to_path IS NOT NULL").select("from_path", "to_path")
    moved = f.file.where("file_no % 3 <> 0").select("path")
    return maintain.wave(imports, f.file.where("file_no % 40 = 3"), lambda pending: pending.join(moved, "path", "left_semi")).orderBy("wave", "path")


_BASELINES = "SELECT md5(CAST(n_nationkey AS STRING)) AS commit_id, CASE WHEN n_nationkey % 5 > 0 THEN '2026-01-' || CAST(10 + n_nationkey AS STRING) END AS analysed_at, n_nationkey % 3 = 0 AS ancestor FROM nation"


@query("choose_baseline", f"SELECT 'absent' AS asked, commit_id, analysed_at FROM (SELECT * FROM ({_BASELINES}) b WHERE ancestor ORDER BY analysed_at DESC NULLS LAST, commit_id LIMIT 1) x UNION ALL SELECT 'exact', commit_id, analysed_at FROM ({_BASELINES}) b WHERE commit_id = md5('4')")
def _(f: Facts) -> DataFrame:
    from hashlib import md5

    stored = f.nation.selectExpr("md5(CAST(n_nationkey AS STRING)) AS commit_id", "CASE WHEN n_nationkey % 5 > 0 THEN '2026-01-' || CAST(10 + n_nationkey AS STRING) END AS analysed_at", "n_nationkey % 3 = 0 AS ancestor")
    pick = lambda asked, commit: maintain.choose_baseline(stored, commit).select(F.lit(asked).alias("asked"), "commit_id", "analysed_at")
    return pick("absent", "none").union(pick("exact", md5(b"4").hexdigest()))


@query("evict_baselines", f"SELECT commit_id FROM (SELECT *, row_number() OVER (ORDER BY ancestor DESC, analysed_at DESC NULLS LAST, commit_id) AS n FROM ({_BASELINES}) b) q WHERE n > 3")
def _(f: Facts) -> DataFrame:
    stored = f.nation.selectExpr("md5(CAST(n_nationkey AS STRING)) AS commit_id", "CASE WHEN n_nationkey % 5 > 0 THEN '2026-01-' || CAST(10 + n_nationkey AS STRING) END AS analysed_at", "n_nationkey % 3 = 0 AS ancestor")
    return maintain.evict(stored, 3).select("commit_id").orderBy("commit_id")



@query("measure", " UNION ALL ".join(f"SELECT config_path, {i} AS ord, '{s}' AS signal, n_key % {i + 2} = (n_key + CASE WHEN n_key % 3 = 0 THEN 1 ELSE 0 END) % {i + 2} AS agrees FROM project" for i, s in enumerate(maintain.SIGNALS)))
def _(f: Facts) -> DataFrame:
    stored = f.project.selectExpr("config_path", *[f"n_key % {i + 2} AS {s}" for i, s in enumerate(maintain.SIGNALS)])
    observed = f.project.selectExpr("config_path", *[f"(n_key + CASE WHEN n_key % 3 = 0 THEN 1 ELSE 0 END) % {i + 2} AS {s}" for i, s in enumerate(maintain.SIGNALS)])
    return maintain.measure(stored, observed, "config_path").orderBy("config_path", "ord")


_CANDIDATES = "SELECT 'g' || CAST(p_partkey % 20 AS STRING) AS subject, 'p' || CAST(p_partkey // 60 AS STRING) AS id, CASE p_size % 4 WHEN 0 THEN 'content-hash' WHEN 1 THEN 'path-prefix-rewrite' WHEN 2 THEN 'git-rename' ELSE 'name-in-head' END AS derivation FROM part"


@query(
    "continuation",
    f"""WITH m AS (SELECT subject, id, list_sort(list(DISTINCT CASE derivation WHEN 'content-hash' THEN 1 WHEN 'path-prefix-rewrite' THEN 2 WHEN 'git-rename' THEN 3 ELSE 4 END)) AS ranks, string_agg(DISTINCT CASE derivation WHEN 'content-hash' THEN '1' WHEN 'path-prefix-rewrite' THEN '2' WHEN 'git-rename' THEN '3' ELSE '4' END || derivation, ',' ORDER BY CASE derivation WHEN 'content-hash' THEN '1' WHEN 'path-prefix-rewrite' THEN '2' WHEN 'git-rename' THEN '3' ELSE '4' END || derivation) AS d FROM ({_CANDIDATES}) c GROUP BY subject, id)
SELECT subject, id, derivations, place, withheld FROM (SELECT subject, id, regexp_replace(d, '[0-9]', '', 'g') AS derivations, row_number() OVER (PARTITION BY subject ORDER BY list_concat(ranks, [99, 99, 99, 99]), id) AS place, greatest(count(*) OVER (PARTITION BY subject) - 10, 0) AS withheld FROM m) q WHERE place <= 10""",
)
def _(f: Facts) -> DataFrame:
    rank = "CASE p_size % 4 WHEN 0 THEN 'content-hash' WHEN 1 THEN 'path-prefix-rewrite' WHEN 2 THEN 'git-rename' ELSE 'name-in-head' END"
    found = f.part.selectExpr("'g' || CAST(p_partkey % 20 AS STRING) AS subject", "'p' || CAST(p_partkey DIV 60 AS STRING) AS id", f"{rank} AS derivation")
    return maintain.continuation(found)


_RENAMES = "SELECT o_custkey AS commit_id, 'a' || CAST(o_orderkey % 3 AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.ts' AS old_path, 'b' || CAST(o_orderkey % 2 AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.ts' AS new_path FROM orders"


@query("rename_sweep", f"WITH r AS (SELECT *, regexp_replace(old_path, '/[^/]*$', '') AS old_dir, regexp_replace(new_path, '/[^/]*$', '') AS new_dir FROM ({_RENAMES}) x) SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY commit_id, old_dir, new_dir) AS n FROM r) q WHERE n > 1 AND old_dir <> new_dir")
def _(f: Facts) -> DataFrame:
    renames = f.orders.selectExpr("o_custkey AS commit_id", "'a' || CAST(o_orderkey % 3 AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.ts' AS old_path", "'b' || CAST(o_orderkey % 2 AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.ts' AS new_path")
    return maintain.rename_sweep(renames)


@query("shape_hash", "SELECT path, sha256(string_agg(name || ':' || kind, '|' ORDER BY name || ':' || kind)) AS shape FROM symbol WHERE durable GROUP BY path")
def _(f: Facts) -> DataFrame:
    return f.symbol.where("durable").groupBy("path").agg(maintain.joined_hash(F.collect_list(F.concat_ws(":", "name", "kind"))).alias("shape")).orderBy("path")
