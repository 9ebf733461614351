"""Benchmark runs: validity, cells, grades, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.bindings import Facts
from loomgraph.operators import rollup as R
from loomgraph.plans.registry import query


@query("invalid_reason", "SELECT run_id, case_id, replicate, CASE WHEN tokens < 3 THEN 'no-output' WHEN cost > 90000 THEN 'over-budget' WHEN invalid THEN 'timed-out' END AS reason FROM run")
def _(f: Facts) -> DataFrame:
    rules = [(F.col("tokens") < 3, "no-output"), (F.col("cost") > 90000, "over-budget"), (F.col("invalid"), "timed-out")]
    return f.run.select("run_id", "case_id", "replicate", R.invalid_reason(rules).alias("reason"))


@query("invalid_reasons", "SELECT arm, reason, count(*) AS n FROM run WHERE reason IS NOT NULL GROUP BY arm, reason")
def _(f: Facts) -> DataFrame:
    return f.run.where("reason IS NOT NULL").groupBy("arm", "reason").agg(F.count("*").alias("n")).orderBy("arm", "reason")


_CELL = "count(*) AS runs, count(*) FILTER (WHERE NOT invalid) AS valid, coalesce(median(tokens) FILTER (WHERE NOT invalid), 0.0) AS tokens, coalesce(median(cost) FILTER (WHERE NOT invalid), 0.0) AS cost, round(avg(share) FILTER (WHERE NOT invalid), 6) AS share"


@query("cell_summary", f"SELECT case_id, arm, {_CELL} FROM run GROUP BY case_id, arm")
def _(f: Facts) -> DataFrame:
    return R.cell(f.run, ["case_id", "arm"]).orderBy("case_id", "arm")


@query("cell_rollup", "SELECT coalesce(level, CASE WHEN grouping(level) = 0 THEN 'unclassified' END) AS level, case_id, arm, count(*) AS runs, count(*) FILTER (WHERE NOT invalid) AS valid, round(sum(cost), 2) AS cost FROM run GROUP BY GROUPING SETS ((level, case_id, arm), (level, arm), (arm))")
def _(f: Facts) -> DataFrame:
    runs = f.run.fillna("unclassified", ["level"])
    sets = [[F.col("level"), F.col("case_id"), F.col("arm")], [F.col("level"), F.col("arm")], [F.col("arm")]]
    return runs.groupingSets(sets, "level", "case_id", "arm").agg(F.count("*").alias("runs"), F.count_if(~F.col("invalid")).alias("valid"), F.round(F.sum("cost"), 2).alias("cost"))


_MODE = "SELECT case_id, arm, grade, n AS votes, CAST(of_all AS BIGINT) AS of FROM (SELECT case_id, arm, grade, n, sum(n) OVER (PARTITION BY case_id, arm) AS of_all, row_number() OVER (PARTITION BY case_id, arm ORDER BY n DESC, CASE grade WHEN 'incorrect' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END) AS k FROM (SELECT case_id, arm, grade, count(*) AS n FROM run GROUP BY 1, 2, 3) c) q WHERE k = 1"


@query("modal_grade", f"SELECT case_id, arm, grade FROM ({_MODE}) m")
def _(f: Facts) -> DataFrame:
    return R.modal(f.run, ["case_id", "arm"], "grade").select("case_id", "arm", "grade").orderBy("case_id", "arm")


@query("consensus", f"SELECT case_id, arm, grade, round(votes / of, 6) AS agreement FROM ({_MODE}) m".replace("AS of FROM", "AS total FROM").replace("/ of,", "/ total,"))
def _(f: Facts) -> DataFrame:
    return R.modal(f.run, ["case_id", "arm"], "grade").select("case_id", "arm", "grade", F.round(F.col("votes") / F.col("of"), 6).alias("agreement")).orderBy("case_id", "arm")


@query("judge_spend", "SELECT arm, count(*) AS judgements, round(sum(cost), 2) AS spend FROM (SELECT arm, judgement, arg_max(cost, (run_id, replicate, cost)) AS cost FROM run GROUP BY arm, judgement) q GROUP BY arm")
def _(f: Facts) -> DataFrame:
    last = f.run.groupBy("arm", "judgement").agg(F.max_by("cost", F.struct("run_id", "replicate", "cost")).alias("cost"))
    return last.groupBy("arm").agg(F.count("*").alias("judgements"), F.round(F.sum("cost"), 2).alias("spend")).orderBy("arm")


@query("take_up", "SELECT arm, coalesce(level, 'unclassified') AS level, count(*) FILTER (WHERE took_up) AS used, count(took_up) AS known, round(count(*) FILTER (WHERE took_up) / nullif(count(took_up), 0), 6) AS share FROM run GROUP BY 1, 2")
def _(f: Facts) -> DataFrame:
    known = F.count("took_up")
    return f.run.groupBy("arm", F.coalesce("level", F.lit("unclassified")).alias("level")).agg(F.count_if(F.col("took_up")).alias("used"), known.alias("known"), F.round(F.count_if(F.col("took_up")) / F.nullif(known, F.lit(0)), 6).alias("share")).orderBy("arm", "level")


@query("score_diff", "WITH d AS (SELECT l_orderkey AS run_id, list_sort(list(DISTINCT l_partkey % 40)) AS files FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey AS run_id, [o_custkey % 40, (o_custkey + 7) % 40, o_orderkey % 40] AS raw FROM orders), s AS (SELECT d.run_id, files, list_distinct(raw) AS truth FROM d JOIN t ON t.run_id = d.run_id) SELECT run_id, CAST(len(list_intersect(files, truth)) AS BIGINT) AS hit, CAST(len(truth) - len(list_intersect(files, truth)) AS BIGINT) AS missed, CAST(len(files) - len(list_intersect(files, truth)) AS BIGINT) AS extra FROM s")
def _(f: Facts) -> DataFrame:
    diff = f.lineitem.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_set(F.col("l_partkey") % 40).alias("files"))
    truth = f.orders.select(F.col("o_orderkey").alias("run_id"), F.array_distinct(F.array(F.col("o_custkey") % 40, (F.col("o_custkey") + 7) % 40, F.col("o_orderkey") % 40)).alias("truth"))
    n = lambda c: F.size(c).cast("long")
    return diff.join(truth, "run_id").select("run_id", n(F.array_intersect("files", "truth")).alias("hit"), n(F.array_except("truth", "files")).alias("missed"), n(F.array_except("files", "truth")).alias("extra"))


@query("pooled_basis", "WITH c AS (SELECT arm, list_sort(list(DISTINCT case_id)) AS cases FROM run WHERE tokens > 45 AND NOT invalid GROUP BY arm) SELECT x.arm AS arm_a, y.arm AS arm_b, x.cases = y.cases AS same, CAST(len(list_intersect(x.cases, y.cases)) AS BIGINT) AS pooled FROM c x JOIN c y ON x.arm < y.arm")
def _(f: Facts) -> DataFrame:
    pairs = f.run.where("tokens > 45 AND NOT invalid").select("arm", "case_id").distinct()
    sizes = pairs.groupBy("arm").agg(F.count("*").alias("n"))
    shared = pairs.select(F.col("arm").alias("arm_a"), "case_id").join(pairs.select(F.col("arm").alias("arm_b"), "case_id"), "case_id").where("arm_a < arm_b").groupBy("arm_a", "arm_b").agg(F.count("*").alias("pooled"))
    a, b = sizes.select(F.col("arm").alias("arm_a"), F.col("n").alias("na")), sizes.select(F.col("arm").alias("arm_b"), F.col("n").alias("nb"))
    return shared.join(a, "arm_a").join(b, "arm_b").select("arm_a", "arm_b", ((F.col("na") == F.col("pooled")) & (F.col("nb") == F.col("pooled"))).alias("same"), "pooled")


@query("arm_pairs", "SELECT a.arm || '/' || CAST(a.replicate AS STRING) AS baseline, b.arm || '/' || CAST(b.replicate AS STRING) AS contender, a.replicate = b.replicate AS like_for_like FROM (SELECT DISTINCT arm, replicate FROM run) a, (SELECT DISTINCT arm, replicate FROM run) b WHERE a.arm = 'N' AND b.arm <> 'N'")
def _(f: Facts) -> DataFrame:
    # Arms are a handful: each baseline carries the list of contenders, exploded, instead of a cross join.
    arms = f.run.select("arm", "replicate").distinct()
    contenders = arms.where("arm <> 'N'").agg(F.collect_list(F.struct("arm", "replicate")).alias("others"))
    pairs = arms.where("arm = 'N'").join(F.broadcast(contenders), how="inner").select("arm", "replicate", F.explode("others").alias("o"))
    name = lambda a, r: F.concat_ws("/", a, r.cast("string"))
    out = pairs.select(name(F.col("arm"), F.col("replicate")).alias("baseline"), name(F.col("o.arm"), F.col("o.replicate")).alias("contender"), (F.col("replicate") == F.col("o.replicate")).alias("like_for_like"))
    return out.orderBy(F.desc("like_for_like"), "baseline", "contender")


_MEDIANS = "SELECT case_id, median(tokens) FILTER (WHERE arm = 'N') AS n, median(tokens) FILTER (WHERE arm = 'A') AS a, median(tokens) FILTER (WHERE arm = 'R') AS r FROM run WHERE NOT invalid GROUP BY case_id"


def _delta(x: str) -> str:
    change = f"CAST(floor(({x} - n) / n * 100 + 0.5) AS BIGINT)"
    return f"CASE WHEN coalesce(n, 0.0) = 0 THEN '—' ELSE CASE WHEN {change} > 0 THEN '+' ELSE '' END || CAST({change} AS STRING) || '%' END"


def _medians(f: Facts, key: str) -> DataFrame:
    mid = lambda arm: F.median(F.when(F.col("arm") == arm, F.col("tokens")))
    return f.run.where("NOT invalid").groupBy(key).agg(mid("N").alias("n"), mid("A").alias("a"), mid("R").alias("r"))


@query("arm_delta", f"SELECT case_id, {_delta('a')} AS a, {_delta('r')} AS r FROM ({_MEDIANS}) m")
def _(f: Facts) -> DataFrame:
    return _medians(f, "case_id").select("case_id", R.percent(F.col("a"), F.col("n")).alias("a"), R.percent(F.col("r"), F.col("n")).alias("r")).orderBy("case_id")


@query("headline", f"SELECT level, n, a, r, {_delta('a')} AS a_delta, {_delta('r')} AS r_delta FROM (SELECT coalesce(level, 'unclassified') AS level, median(tokens) FILTER (WHERE arm = 'N') AS n, median(tokens) FILTER (WHERE arm = 'A') AS a, median(tokens) FILTER (WHERE arm = 'R') AS r FROM run WHERE NOT invalid GROUP BY 1) m")
def _(f: Facts) -> DataFrame:
    mid = lambda arm: F.median(F.when(F.col("arm") == arm, F.col("tokens")))
    m = f.run.where("NOT invalid").groupBy(F.coalesce("level", F.lit("unclassified")).alias("level")).agg(mid("N").alias("n"), mid("A").alias("a"), mid("R").alias("r"))
    return m.select("level", "n", "a", "r", R.percent(F.col("a"), F.col("n")).alias("a_delta"), R.percent(F.col("r"), F.col("n")).alias("r_delta")).orderBy("level")


@query("discarded", "SELECT reason, count(*) FILTER (WHERE arm = 'A') AS a, count(*) FILTER (WHERE arm = 'N') AS n, count(*) FILTER (WHERE arm = 'R') AS r FROM run WHERE invalid GROUP BY reason")
def _(f: Facts) -> DataFrame:
    return f.run.where("invalid").groupBy("reason").pivot("arm", ["A", "N", "R"]).count().fillna(0).select("reason", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("judgement_key", "SELECT run_id, replicate, substring(sha256(CAST(case_id AS STRING) || chr(0) || arm || chr(0) || grade), 1, 16) AS key FROM run")
def _(f: Facts) -> DataFrame:
    return f.run.select("run_id", "replicate", F.substring(F.sha2(F.concat_ws("\0", F.col("case_id").cast("string"), "arm", "grade"), 256), 1, 16).alias("key"))
