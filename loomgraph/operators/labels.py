"""Label signals, their precedence, scope, and what the answers say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.lookup import winner
from loomgraph.schema import ENUMS

PRECEDENCE = ("user-config", "git-untracked", "generated-header", "codegen-path", "path-convention", "tsconfig-exclude", "default")


def rank_of(column: str, order: tuple[str, ...]) -> Column:
    """Place of a value in a closed list."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(column))


def effective(labels: DataFrame) -> DataFrame:
    """The label of the strongest derivation per (node, axis)."""
    return winner(labels, ["node", "axis"], rank_of("derivation", PRECEDENCE), ["value", "provenance", "derivation"])


def effective_wide(labels: DataFrame) -> DataFrame:
    """(node, role, authorship), one pass over the signals."""
    rank = rank_of("derivation", PRECEDENCE)
    pick = lambda axis: F.min_by(F.when(F.col("axis") == axis, F.col("value")), F.when(F.col("axis") == axis, rank))
    return labels.groupBy("node").agg(pick("role").alias("role"), pick("authorship").alias("authorship"))


def scoped(rows: DataFrame, labels: DataFrame, path: str = "path", include: dict[str, str] | None = None, exclude: dict[str, str] | None = None) -> DataFrame:
    """Rows with ``in_scope``: all include filters hold on the path's effective labels and no exclude filter does.

    Paths without labels count as authored source. The default keeps authored files.
    """
    include = {"authorship": "authored"} if include is None else include
    wide = effective_wide(labels).withColumnRenamed("node", path)
    axes = {"role": F.coalesce("role", F.lit("source")), "authorship": F.coalesce("authorship", F.lit("authored"))}
    keep = F.lit(True)
    for axis, value in include.items():
        keep = keep & (axes[axis] == value)
    for axis, value in (exclude or {}).items():
        keep = keep & (axes[axis] != value)
    return rows.join(wide, path, "left").withColumn("in_scope", keep).drop("role", "authorship")


AXES = {"role": ENUMS["role"], "authorship": ENUMS["authorship"]}


def parse_filter(raw: str) -> tuple[str, str]:
    """(axis, value) of ``axis=value``. Both lists are closed: a filter that is misspelt is refused, as it would match nothing."""
    axis, _, value = raw.partition("=")
    if axis not in AXES:
        raise ValueError(f"expected an axis of {' or '.join(AXES)}, not {raw!r}")
    if value not in AXES[axis]:
        raise ValueError(f"expected {axis} to be one of {', '.join(AXES[axis])}, not {value!r}")
    return axis, value


def filters(given: dict[str, str] | list[str] | None) -> dict[str, str] | None:
    """Filters as a checked dict, from a dict or from ``axis=value`` texts; None stays None, which means the default."""
    return None if given is None else dict(parse_filter(x if isinstance(given, list) else f"{x}={given[x]}") for x in given)


def disagreements(labels: DataFrame) -> DataFrame:
    """(node, axis) on which signals other than the default name more than one value."""
    found = labels.where("derivation <> 'default'").groupBy("node", "axis").agg(F.array_sort(F.collect_set("value")).alias("all"))
    return found.where(F.size("all") > 1).select("node", "axis", F.array_join("all", ",").alias("found"))


def classify(paths: DataFrame, rules: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """Role and authorship of each path by ordered rules (regex, role, authorship); per axis the last one that matches and names it wins."""
    out = {"role": F.lit(None).cast("string"), "authorship": F.lit(None).cast("string")}
    for regex, role, authorship in rules:
        for axis, value in (("role", role), ("authorship", authorship)):
            if value:
                out[axis] = F.when(F.col("path").rlike(regex), F.lit(value)).otherwise(out[axis])
    return paths.withColumns(out)


TEST_PATHS = (r"(^|/)__tests__/", r"(^|/)tests?/", r"\.(spec|test)\.(c|m)?(j|t)sx?$", r"(^|/)e2e/", r"(^|/)fixtures?/")
CONFIG_PATHS = (r"(^|/)\.[^/]+rc\.[cm]?[jt]s$", r"\.config\.[cm]?[jt]s$", r"(^|/)(vite|jest|next)\.[^/]*$")
CODEGEN_PATHS = (r"(^|/)__generated__/", r"(^|/)generated/", r"\.generated\.[cm]?[jt]sx?$", r"\.gen\.[cm]?[jt]sx?$", r"\.pb\.[cm]?[jt]s$", r"_pb\.[cm]?[jt]s$")


def _any(path: Column, regexes: tuple[str, ...]) -> Column:
    return path.rlike("|".join(f"(?:{r})" for r in regexes))


def role_from_path(path: Column) -> Column:
    """test, config or null by convention."""
    return F.when(_any(path, TEST_PATHS), "test").when(_any(path, CONFIG_PATHS), "config")


def codegen_path(path: Column) -> Column:
    return _any(path, CODEGEN_PATHS)


def generated_header(text: Column) -> Column:
    """Whether one of the first five lines of the first 512 characters says that the file is generated."""
    head = F.slice(F.split(F.substring(text, 1, 512), "\n"), 1, 5)
    return F.exists(head, lambda line: F.lower(line).rlike("@generated|do not edit|auto-?generated|code generated"))


def signals(files: DataFrame, configured: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """All signals of files (``path``, ``untracked``, ``head``): two defaults, path role, tracking, header, codegen path, rules."""
    path = F.col("path")
    rules = classify(files.select("path"), configured)
    row = lambda axis, value, derivation, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(axis).alias("axis"), (value if isinstance(value, Column) else F.lit(value)).alias("value"), F.lit(derivation).alias("derivation")))
    role = role_from_path(path)
    found = F.array(
        row("role", "source", "default"), row("authorship", "authored", "default"), row("role", role, "path-convention", role.isNotNull()), row("authorship", "generated", "git-untracked", F.col("untracked")), row("authorship", "generated", "generated-header", generated_header(F.col("head"))), row("authorship", "generated", "codegen-path", codegen_path(path)),
        row("role", F.col("rule_role"), "user-config", F.col("rule_role").isNotNull()), row("authorship", F.col("rule_authorship"), "user-config", F.col("rule_authorship").isNotNull()),
    )
    joined = files.join(rules.select("path", F.col("role").alias("rule_role"), F.col("authorship").alias("rule_authorship")).distinct(), "path")
    return joined.select(path.alias("node"), F.explode(F.filter(found, lambda s: s.isNotNull())).alias("s")).select("node", "s.*")
