"""Documentation claims: parsing, evaluation of all claims at once, verdicts, and claims from facts.

Every predicate family is one join, so the cost doesn't follow the number of claims one by one.
Faults and unresolved subjects are rows with a reason, never errors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import labels as L
from loomgraph.session import sent

_NAME = "([A-Za-z][0-9A-Za-z]*)"
_ARGUMENTS = r"\(([^)]*)\)"
SHAPE = r"^(!?)\s*" + _NAME + r"\s*" + _ARGUMENTS + r"\s*(.*)$"
ARITY = {"exists": 1, "calls": 2, "reaches": 2, "references": 2, "extends": 2, "implements": 2, "usesType": 2, "imports": 2, "hasLabel": 3, "onlyCalledBy": 2, "callers": 1, "implementations": 1}
COUNTS = ("callers", "implementations")
NO_BACKEND = ("exports", "dependsOn")
REFERENCE_KINDS = {"references": "references", "extends": "extends", "implements": "implements", "usesType": "typeReferences"}
LABEL_VALUES = ("role=source", "role=test", "role=config", "authorship=authored", "authorship=generated")


def parse(text: Column) -> Column:
    """struct(negated, predicate, args, count, fault) of a claim's text."""
    group = lambda i: F.regexp_extract(text, SHAPE, i)
    predicate, tail = group(2), group(4)
    args = F.transform(F.split(group(3), ","), lambda a: F.trim(a))
    arity = F.create_map(*[F.lit(x) for kv in ARITY.items() for x in kv])[predicate]
    number = F.regexp_extract(tail, r"^==\s*([0-9]+)\s*$", 1)
    counted = predicate.isin(*COUNTS)
    fault = (
        F.when(~text.rlike(SHAPE), "unparseable")
        .when(predicate.isin(*NO_BACKEND), "no-backend")
        .when(arity.isNull(), "unknown-predicate")
        .when(F.size(args) != arity, "arity")
        .when(counted & (number == ""), "count-invalid")
        .when(~counted & (F.trim(tail) != ""), "unparseable")
        .when((predicate == "onlyCalledBy") & (group(1) == "!"), "no-backend")
        .when((predicate == "hasLabel") & ~F.concat_ws("=", args[1], args[2]).isin(*LABEL_VALUES), "label-invalid")
    )
    return F.struct((group(1) == "!").alias("negated"), predicate.alias("predicate"), args.alias("args"), F.when(counted & (number != ""), number.cast("long")).alias("count"), fault.alias("fault"))


def reach_pairs(claims: DataFrame) -> DataFrame:
    """(a, b) that ``reaches`` claims ask about."""
    asked = claims.select(parse(F.col("text")).alias("p")).where("p.predicate = 'reaches' AND p.fault IS NULL")
    return asked.select(F.col("p.args")[0].alias("a"), F.col("p.args")[1].alias("b")).distinct()


def _imported(known: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports that claims ask about: where those are few, the others are left out before they are moved."""
    asked = sent(known.where("predicate = 'imports'").select(F.col("path_a").alias("from_path"), F.col("path_b").alias("to_path")).distinct())
    found = imports.where("to_path IS NOT NULL").join(asked, ["from_path", "to_path"], "left_semi")
    return found.select(F.col("from_path").alias("path_a"), F.col("to_path").alias("path_b"), F.lit(True).alias("imported")).distinct()


def _outside(known: DataFrame, calls: DataFrame) -> DataFrame:
    """(claim_no, outside): call sites that ``onlyCalledBy`` doesn't allow."""
    asked = known.where("predicate = 'onlyCalledBy'").select("claim_no", F.col("a").alias("to_id"), F.concat(F.regexp_replace("b", "/$", ""), F.lit("/")).alias("dir"))
    sites = asked.join(calls.select("to_id", F.col("path").alias("site")), "to_id").where(~F.col("site").startswith(F.col("dir")))
    return sites.groupBy("claim_no").agg(F.count("*").alias("outside"))


def evaluate(claims: DataFrame, symbols: DataFrame, calls: DataFrame, refs: DataFrame, imports: DataFrame, labels: DataFrame, doubts: DataFrame, held: DataFrame | None = None, predicates: tuple[str, ...] | None = None) -> DataFrame:
    """Claims (``claim_no``, ``text``) with verdict, reason and what was observed.

    ``held``: (a, b, holds) of the pairs in ``reach_pairs``, which only a walk can tell; those it lacks don't hold.

    ``doubts``: (path, syntactic, broken) says what is not known of a file. A claim of presence is
    doubted only where nothing was found, a count in either case, ``hasLabel`` never.

    ``predicates``: the claims that are asked for, all by default; no other facts than theirs are read.
    """
    parsed = claims.withColumn("p", parse(F.col("text"))).select("claim_no", "text", "p.*").withColumns({"a": F.get("args", F.lit(0)), "b": F.get("args", F.lit(1)), "c": F.get("args", F.lit(2))})
    if predicates is not None:
        parsed = parsed.where(F.col("predicate").isin(*predicates))
    asks = lambda *names: predicates is None or any(n in predicates for n in names)
    side = lambda x: symbols.select(F.col("id").alias(x), F.col("path").alias(f"path_{x}"), F.col("durable").alias(f"durable_{x}"))
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    kind = F.create_map(*[F.lit(x) for kv in REFERENCE_KINDS.items() for x in kv])
    known = parsed.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("kind", F.coalesce(kind[F.col("predicate")], F.lit("")))

    def add(wanted: bool, found: Callable[[], DataFrame], on: list[str], column: str, null: str) -> None:
        nonlocal known
        known = known.join(found(), on, "left") if wanted else known.withColumn(column, F.lit(None).cast(null))

    add(asks("calls"), lambda: flag(calls.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), "called"), ["a", "b"], "called", "boolean")
    add(asks(*REFERENCE_KINDS), lambda: flag(refs.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "kind"), "referred"), ["a", "b", "kind"], "referred", "boolean")
    add(asks("imports"), lambda: _imported(known, imports), ["path_a", "path_b"], "imported", "boolean")
    add(asks("hasLabel"), lambda: L.effective(labels).select(F.col("node").alias("path_a"), F.col("axis").alias("b"), F.col("value").alias("c"), F.lit(True).alias("labelled")), ["path_a", "b", "c"], "labelled", "boolean")
    add(asks("callers"), lambda: calls.groupBy(F.col("to_id").alias("a")).agg(F.count_distinct("from_id").alias("n_callers")), ["a"], "n_callers", "long")
    add(asks("implementations"), lambda: refs.where("kind = 'implements'").groupBy(F.col("to_id").alias("a")).agg(F.count_distinct("from_id").alias("n_implementations")), ["a"], "n_implementations", "long")
    add(asks("onlyCalledBy"), lambda: _outside(known, calls), ["claim_no"], "outside", "long")
    add(held is not None, lambda: held.where("holds").select("a", "b", F.lit(True).alias("reached")).distinct(), ["a", "b"], "reached", "boolean")
    dark = lambda x: sent(doubts.select(F.col("path").alias(f"path_{x}"), F.col("syntactic").alias(f"syntactic_{x}"), F.col("broken").alias(f"broken_{x}")))
    known = known.join(dark("a"), "path_a", "left").join(dark("b"), "path_b", "left")
    predicate, yes = F.col("predicate"), lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    observed = F.when(predicate == "callers", zero("n_callers")).when(predicate == "implementations", zero("n_implementations")).when(predicate == "onlyCalledBy", zero("outside"))
    present = F.when(predicate == "exists", F.col("path_a").isNotNull()).when(predicate == "calls", yes("called")).when(predicate == "reaches", yes("reached")).when(predicate.isin(*REFERENCE_KINDS), yes("referred")).when(predicate == "imports", yes("imported")).when(predicate == "hasLabel", yes("labelled")).when(predicate == "onlyCalledBy", F.col("observed") == 0).otherwise(F.col("observed") == F.col("count"))
    whole = predicate.isin(*COUNTS)
    second = predicate.isin("calls", "reaches", "imports", *REFERENCE_KINDS)
    unresolved = F.when(predicate == "exists", F.col("path_a").isNull() & ~F.col("negated")).otherwise(F.col("path_a").isNull() | (second & F.col("path_b").isNull()))
    local = (F.col("durable_a") == F.lit(False)) | (second & (F.col("durable_b") == F.lit(False)))
    doubt = F.when(predicate != "hasLabel", F.when(yes("syntactic_a") | (second & yes("syntactic_b")), "syntactic").when(yes("broken_a") | (second & yes("broken_b")), "unresolved-specifier"))
    doubted = F.col("doubt").isNotNull() & (F.col("whole") | ~F.col("present"))
    holds = F.col("present") != (F.col("negated") & ~F.col("whole"))
    state = known.withColumn("observed", observed).withColumns({"present": present, "whole": whole, "doubt": doubt, "unresolved": unresolved, "fault": F.coalesce(F.col("fault"), F.when(local, "local-subject"))})
    reason = F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("unresolved"), "unresolved").when(doubted, F.col("doubt")).when(holds, "holds").when(F.col("whole"), "count-differs").otherwise("falsified")
    verdict = F.when(F.col("fault").isNotNull(), F.lit(None).cast("string")).when(F.col("unresolved") | doubted, "unable-to-verify").when(holds, "verified").otherwise("contradicted")
    return state.select("claim_no", "text", "predicate", "negated", verdict.alias("verdict"), reason.alias("reason"), F.when(F.col("fault").isNull(), F.col("observed")).alias("observed"), F.col("fault").isNotNull().alias("faulty"))


SEVERITY = ("contradicted", "unable-to-verify", "potentially-stale", "verified")


def section_verdicts(evaluated: DataFrame, sections: DataFrame) -> DataFrame:
    """Per section (``doc, section, broken_links, links, touched``): contradicted, else unable, else stale where its scope changed, else verified; null without claims and links."""
    claims = evaluated.groupBy("doc", "section").agg(F.count("*").alias("claims"), F.count_if(F.col("verdict") == "contradicted").alias("bad"), F.count_if(F.col("verdict") == "unable-to-verify").alias("unable"))
    joined = sections.join(claims, ["doc", "section"], "left").fillna(0, ["claims", "bad", "unable"])
    verdict = F.when((F.col("claims") == 0) & (F.col("links") == 0), F.lit(None).cast("string")).when((F.col("bad") > 0) | (F.col("broken_links") > 0), "contradicted").when(F.col("unable") > 0, "unable-to-verify").when(F.col("touched"), "potentially-stale").otherwise("verified")
    return joined.select("doc", "section", "claims", verdict.alias("verdict"))


def document_verdicts(sections: DataFrame) -> DataFrame:
    """The gravest verdict among a document's sections, and what part of them has claims."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("verdict"))
    return sections.groupBy("doc").agg(F.min_by("verdict", rank).alias("verdict"), F.count_if(F.col("claims") > 0).alias("covered"), F.count("*").alias("sections"))


def from_facts(symbols: DataFrame, calls: DataFrame, refs: DataFrame, imports: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(owner, claim) that facts support; edges attributed to files and ends that don't last are left out, repeated claims once.

    ``owners`` (``owner``): those asked for, all by default. Facts of others are left out before they are moved.
    """
    lasting = symbols.where("durable").select("id")
    ends = lambda df: df.join(lasting.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(lasting.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    asked = None if owners is None else sent(owners.select("owner").distinct())
    of = lambda df, c: df if asked is None else df.join(asked.withColumnRenamed("owner", c), c, "left_semi")
    verb = F.when(F.col("kind") == "typeReferences", "usesType").otherwise(F.col("kind"))
    found = [
        of(lasting, "id").select(F.col("id").alias("owner"), F.format_string("exists(%s)", "id").alias("claim")),
        ends(of(calls.where("attribution <> 'file'"), "from_id").select("from_id", "to_id").distinct()).select("from_id", F.format_string("calls(%s, %s)", "from_id", "to_id")),
        ends(of(refs, "from_id").select("from_id", "to_id", "kind").distinct()).select("from_id", F.format_string("%s(%s, %s)", verb, "from_id", "to_id")),
        of(imports.where("to_path IS NOT NULL"), "from_path").select("from_path", F.format_string("imports(%s, %s)", "from_path", "to_path")),
    ]
    out = found[0]
    for p in found[1:]:
        out = out.union(p)
    return out.distinct()


def claim_paths(text: Column) -> Column:
    """Arguments that name files: cut at ``#``, with a slash or a TypeScript extension."""
    args = F.split(F.regexp_extract(text, r"\(([^)]*)\)", 1), ",")
    names = F.transform(args, lambda a: F.regexp_replace(F.trim(a), "#.*$", ""))
    return F.array_distinct(F.filter(names, lambda n: n.contains("/") | n.rlike(r"\.[cm]?tsx?$")))
