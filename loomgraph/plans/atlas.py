"""Timelines, health and churn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.bindings import Facts
from loomgraph.operators import atlas as A
from loomgraph.plans.registry import query


@query("timeline_files", "SELECT path, max(calls_in) AS calls_in, max(calls_out) AS calls_out, max(unresolved) AS unresolved, arg_max(calls_in, day) AS last_calls_in FROM frame GROUP BY path")
def _(f: Facts) -> DataFrame:
    return A.merge_timeline(f.frame, "path", "day", ["calls_in", "calls_out", "unresolved"], ["calls_in"]).orderBy("path")


_DAY = "datediff('day', DATE '2024-01-01', day)"


@query("lifetimes", f"SELECT path, CAST(min({_DAY}) AS BIGINT) AS birth, CAST(max({_DAY}) + 1 AS BIGINT) AS death FROM frame GROUP BY path")
def _(f: Facts) -> DataFrame:
    frames = f.frame.withColumn("n", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long"))
    return A.lifetimes(frames, ["path"], "n").orderBy("path")


@query("timeline_links", f"WITH p AS (SELECT author, day, path, count(*) AS n FROM churn GROUP BY 1, 2, 3), w AS (SELECT x.path AS a, y.path AS b, x.day, count(*) AS weight FROM p x JOIN p y ON x.author = y.author AND x.day = y.day AND x.path < y.path GROUP BY 1, 2, 3) SELECT a, b, max(weight) AS weight, CAST(min({_DAY}) AS BIGINT) AS birth, CAST(max({_DAY}) + 1 AS BIGINT) AS death FROM w GROUP BY a, b")
def _(f: Facts) -> DataFrame:
    per = f.churn.select("author", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("n"), "path").distinct()
    pairs = per.join(per.withColumnRenamed("path", "b"), ["author", "n"]).where("path < b").groupBy(F.col("path").alias("a"), "b", "n").agg(F.count("*").alias("w"))
    return pairs.groupBy("a", "b").agg(F.max("w").alias("weight"), F.min("n").alias("birth"), (F.max("n") + 1).alias("death"))


@query("health_scores", "SELECT path, round(sqrt(least(100.0, n) / 100), 6) AS heat, round(greatest(0.0, least(1.0, (85 - mi) / 35)), 6) AS wear, CAST(sign(a - d) AS BIGINT) AS trend FROM (SELECT path, CAST(count(*) AS DOUBLE) AS n, CAST(avg(k) AS DOUBLE) AS mi, sum(added) AS a, sum(deleted) AS d FROM churn GROUP BY path) q")
def _(f: Facts) -> DataFrame:
    per = f.churn.groupBy("path").agg(F.count("*").cast("double").alias("n"), F.avg("k").alias("mi"), F.sum("added").alias("a"), F.sum("deleted").alias("d"))
    return per.select("path", F.round(A.heat(F.col("n")), 6).alias("heat"), F.round(A.wear(F.col("mi")), 6).alias("wear"), F.sign(F.col("a") - F.col("d")).cast("long").alias("trend")).orderBy("path")


@query("health_blend", f"WITH s AS (SELECT path, CAST({_DAY} AS BIGINT) AS n, CAST(sum(calls_in) AS DOUBLE) AS v FROM frame GROUP BY 1, 2), x AS (SELECT path, max(CASE WHEN n <= 4.25 THEN n END) AS lo, min(CASE WHEN n > 4.25 THEN n END) AS hi FROM s GROUP BY path) SELECT x.path, round(CASE WHEN lo IS NULL THEN b.v WHEN hi IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (4.25 - lo) / (hi - lo) END, 6) AS v FROM x LEFT JOIN s a ON a.path = x.path AND a.n = lo LEFT JOIN s b ON b.path = x.path AND b.n = hi")
def _(f: Facts) -> DataFrame:
    s = f.frame.groupBy("path", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("n")).agg(F.sum("calls_in").cast("double").alias("v"))
    return A.blend(s, "path", "n", "v", F.lit(4.25)).select("path", F.round("v", 6).alias("v")).orderBy("path")


@query("file_health", "WITH u AS (SELECT path, count(*) AS n FROM unresolved_call GROUP BY path), i AS (SELECT from_path AS path, count(*) FILTER (WHERE to_path IS NULL) AS broken FROM file_import GROUP BY 1), d AS (SELECT path FROM file WHERE path NOT IN (SELECT to_path FROM file_import WHERE to_path IS NOT NULL)), c AS (SELECT DISTINCT x.from_path AS path FROM file_import x JOIN file_import y ON y.from_path = x.to_path AND y.to_path = x.from_path WHERE x.from_path <> x.to_path) SELECT file.path, coalesce(u.n, 0) AS hotspots, coalesce(broken, 0) AS broken, d.path IS NOT NULL AS dead, c.path IS NOT NULL AS cyclic FROM file LEFT JOIN u ON u.path = file.path LEFT JOIN i ON i.path = file.path LEFT JOIN d ON d.path = file.path LEFT JOIN c ON c.path = file.path")
def _(f: Facts) -> DataFrame:
    yes = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    cyclic = A.mutual(f.file_import.where("to_path IS NOT NULL").select(F.col("from_path").alias("a"), F.col("to_path").alias("b")))
    imported = f.file_import.where("to_path IS NOT NULL").select(F.col("to_path").alias("path")).distinct()
    dead = f.file.select("path").join(imported, "path", "left_anti")
    hot = f.unresolved_call.groupBy("path").agg(F.count("*").alias("hotspots"))
    broken = f.file_import.groupBy(F.col("from_path").alias("path")).agg(F.count_if(F.col("to_path").isNull()).alias("broken"))
    out = f.file.select("path").join(hot, "path", "left").join(broken, "path", "left").join(yes(dead, "dead"), "path", "left").join(yes(cyclic, "cyclic"), "path", "left")
    return out.fillna(0, ["hotspots", "broken"]).fillna(False, ["dead", "cyclic"]).orderBy("path")


@query("visibility", f"SELECT path, round(greatest(0.0, least(1.0, (10.5 - birth) / 3 + 1)) * greatest(0.0, least(1.0, (death - 10.5) / 3)), 6) AS seen FROM (SELECT path, min({_DAY}) AS birth, max({_DAY}) + 1 AS death FROM frame GROUP BY path) q")
def _(f: Facts) -> DataFrame:
    frames = f.frame.withColumn("n", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long"))
    lives = A.lifetimes(frames, ["path"], "n")
    return lives.select("path", F.round(A.visibility(F.lit(10.5), F.col("birth"), F.col("death"), 3.0), 6).alias("seen")).orderBy("path")


@query("churn_window", "SELECT path, count(*) AS commits, CAST(sum(added + deleted) AS BIGINT) AS churn, count(DISTINCT author) AS authors FROM churn WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY path")
def _(f: Facts) -> DataFrame:
    # The newest commit is one row; the window's lower end is a literal, so the filter reaches the scan.
    head = f.events.agg(F.max("ts")).first()[0]
    recent = f.churn.where(F.col("ts") > F.lit(head) - F.expr("INTERVAL 10 DAY"))
    return recent.groupBy("path").agg(F.count("*").alias("commits"), F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.count_distinct("author").alias("authors")).orderBy("path")


@query("sample_even", "WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM churn) x), k AS (SELECT DISTINCT floor(k / 11.0 * (n - 1) + 0.5) AS place FROM (SELECT unnest(range(0, 12)) AS k) y, (SELECT DISTINCT n FROM d) z) SELECT day, CAST(d.place AS BIGINT) AS place FROM d JOIN k ON k.place = d.place")
def _(f: Facts) -> DataFrame:
    return A.sample_even(f.churn.select("day").distinct(), ["day"], 12).select("day", F.col("place").cast("long").alias("place")).orderBy("place")
