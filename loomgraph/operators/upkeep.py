"""What an analysis pass decides about its index: whether it is stale, what it extracts again, what it can't compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import SCHEMA_VERSION


def header(meta: DataFrame, names: list[str]) -> DataFrame:
    """One row of the named entries of a key-value table; null where one is missing."""
    return meta.agg(*[F.max(F.when(F.col("key") == n, F.col("value"))).alias(n) for n in names])


def stale_reason(meta: DataFrame, symbols: DataFrame, tool: str, compiler: str, schema: int = SCHEMA_VERSION) -> DataFrame:
    """One row (``reason``): why the whole index has to be derived again, or null. The first that holds counts.

    Reasons: ``schema`` (another one, or none is named), ``empty`` (no symbol), ``tool``, ``compiler``.
    """
    one = header(meta, ["schemaVersion", "toolVersion", "compilerVersion"]).join(F.broadcast(symbols.limit(1).agg(F.count("*").alias("n"))), how="inner")
    differs = lambda c, v: ~F.col(c).eqNullSafe(F.lit(v))
    reason = F.when(differs("schemaVersion", str(schema)), "schema").when(F.col("n") == 0, "empty").when(differs("toolVersion", tool), "tool").when(differs("compilerVersion", compiler), "compiler")
    return one.select(reason.alias("reason"))


def reanalysed_files(owners: DataFrame, moved: DataFrame) -> DataFrame:
    """(path): the files that moved projects (``config_path``) own, whether they are the canonical owner or held before."""
    return owners.join(moved.select(F.col("config_path").alias("project")).distinct(), "project", "left_semi").select("path").distinct()


def touched_projects(projects: DataFrame, owners: DataFrame, extracted: DataFrame, refreshed: DataFrame, now: str) -> DataFrame:
    """Rows of the projects whose files (``path``) were extracted again, with the time of this pass.

    A project that was analysed for a change of its environment has its row in ``refreshed``;
    a known one keeps its row but for the time, its count of files included, as a pass doesn't
    list a project again; one without a row counts its members.
    """
    mine = owners.where("canonical").join(extracted.select("path").distinct(), "path", "left_semi").select(F.col("project").alias("config_path")).distinct()
    sizes = owners.groupBy(F.col("project").alias("config_path")).agg(F.count("*").cast("int").alias("members"))
    columns = [c for c in projects.columns if c != "config_path"]
    known = projects.select("config_path", F.struct(*columns).alias("known"))
    fresh = refreshed.select("config_path", F.struct(*columns).alias("fresh"))
    joined = mine.join(known, "config_path", "left").join(fresh, "config_path", "left").join(sizes, "config_path", "left")
    pick = {c: F.coalesce(F.col(f"fresh.{c}"), F.col(f"known.{c}")) for c in columns}
    pick["analysed_at"] = F.when(F.col("fresh").isNotNull(), F.col("fresh.analysed_at")).otherwise(F.lit(now))
    pick["root_file_count"] = F.coalesce(F.col("fresh.root_file_count"), F.col("known.root_file_count"), F.col("members"))
    pick["fidelity"] = F.coalesce(pick["fidelity"], F.lit("typed"))
    return joined.select("config_path", *[pick[c].alias(c) for c in columns])


def merged_projects(projects: DataFrame, touched: DataFrame) -> DataFrame:
    """All project rows, those of ``touched`` in place of older ones."""
    return projects.join(touched.select("config_path"), "config_path", "left_anti").unionByName(touched)


def exclusions(changes: DataFrame, owners: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes (``path``, ``change``) with ``excluded``: the reason why a file's two states can't be compared, or null.

    A file whose project was read at another fidelity (``config_path``, ``fidelity``) before than after has
    facts of another kind, so its change says nothing.
    """
    was = before.select(F.col("config_path").alias("project"), F.col("fidelity").alias("was"))
    now = after.select(F.col("config_path").alias("project"), F.col("fidelity").alias("now"))
    moved = was.join(now, "project").where("was <> now").select("project")
    dark = owners.where("canonical").join(moved, "project", "left_semi").select("path", F.lit("fidelity-changed").alias("excluded")).distinct()
    return changes.select("path", "change").join(dark, "path", "left")


def seeds_of(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id): symbols of files that changed or were added and can be compared."""
    touched = changes.where("change <> 'removed' AND excluded IS NULL").select("path").distinct()
    return symbols.join(touched, "path", "left_semi").select("id")


def impact_spots(changes: DataFrame, absent: str | None = None) -> DataFrame:
    """(subject, reason): what an impact answer couldn't see: a baseline that is missing, files that can't be compared."""
    spots = changes.where("excluded IS NOT NULL").select(F.col("path").alias("subject"), F.col("excluded").alias("reason"))
    return spots if absent is None else spots.union(changes.sparkSession.sql(f"SELECT 'baseline', '{absent}'"))


def inside(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path doesn't leave the repository."""
    return paths.where(~F.col(path).startswith("../"))
