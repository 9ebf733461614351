"""The public operations over facts. Each gives an ``Envelope``; nothing runs before its rows are read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.envelope import Envelope, missing
from loomgraph.facts import FactStore, repaired
from loomgraph.operators import claims, edges, files, lookup, maintain, upkeep, walks
from loomgraph.operators import labels as L
from loomgraph.session import checkpoint
from loomgraph.sources import text as text_sources

REMEDIABLE = ("unprepared", "missing-generated")
MARKER = r"(?s)<!--\s*claim:\s*(.*?)\s*-->"


class Operations:
    """Operations over a fact store or bound facts: any object with the relations as attributes."""

    def __init__(self, facts, include: dict[str, str] | list[str] | None = None, exclude: dict[str, str] | list[str] | None = None, limit: int | None = None):  # noqa: ANN001
        """Filters are dicts or ``axis=value`` texts; one that names no known axis or value is refused."""
        self.facts, self.limit = facts, limit
        self.include, self.exclude = L.filters(include), L.filters(exclude)

    # Parts that answers share.

    def _subjects(self, names: list[str]) -> DataFrame:
        spark = self.facts.symbol.sparkSession
        return spark.createDataFrame([(n,) for n in names], "subject string")

    def _resolve(self, names: list[str]) -> DataFrame:
        return lookup.resolve_subjects(self.facts.symbol, self._subjects(names))

    def _scoped(self, rows: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
        marked = L.scoped(rows, self.facts.label, path, self.include, self.exclude)
        return marked.where("in_scope").drop("in_scope"), marked.agg(F.count_if(~F.col("in_scope")).alias("excluded"))

    def _envelope(self, operation: str, request: dict, result: DataFrame, touched: DataFrame, excluded: DataFrame | None = None, order: list[str] | None = None, **more) -> Envelope:  # noqa: ANN003
        owners = self.facts.file_project.join(touched.distinct(), "path", "left_semi").select(F.col("project").alias("config_path")).distinct()
        conditions = self.facts.project.where("cause IS NOT NULL").join(owners, "config_path", "left_semi").select("config_path", "cause").orderBy("config_path")
        spots = self.facts.unresolved_specifier.join(touched.distinct(), "path", "left_semi").groupBy("specifier", "cause").agg(F.count("*").alias("sites")).orderBy("specifier", "cause")
        return Envelope(operation, request, result.orderBy(*order) if order else result, conditions, spots, excluded, self.limit, **more)

    # Operations.

    def symbol(self, *patterns: str) -> Envelope:
        """Symbols whose name or qualified name matches any of the globs."""
        found = None
        for p in patterns:
            part = lookup.glob(self.facts.symbol, p)
            found = part if found is None else found.union(part).distinct()
        rows, excluded = self._scoped(found)
        return self._envelope("symbol", {"subject": list(patterns)}, rows, rows.select("path"), excluded, ["id", "path"])

    def _edges(self, operation: str, names: tuple[str, ...], pick: Callable[[DataFrame, DataFrame], DataFrame]) -> Envelope:
        subjects = self._resolve(list(names))
        rows, excluded = self._scoped(pick(self.facts.call_edge, subjects))
        return self._envelope(operation, {"subject": list(names)}, rows, rows.select("path"), excluded, edges.CALL_ORDER)

    def callers(self, *subjects: str) -> Envelope:
        """One row per call site of a subject."""
        return self._edges("callers", subjects, edges.callers)

    def callees(self, *subjects: str) -> Envelope:
        """One row per call site in a subject."""
        return self._edges("callees", subjects, edges.callees)

    def references(self, *subjects: str) -> Envelope:
        """References out of the subjects, and into them from elsewhere."""
        rows, excluded = self._scoped(edges.references(self.facts.reference_edge, self._resolve(list(subjects))))
        return self._envelope("references", {"subject": list(subjects)}, rows, rows.select("path"), excluded, ["from_id", "to_id", "kind", "path", "line"])

    def file(self, *paths: str) -> Envelope:
        """Projects, fidelity, symbols, imports and importers of files."""
        asked = lookup.resolve_paths(self.facts.file, self._subjects(list(paths))).select("path").distinct()
        rows = files.report(asked, self.facts.file_project, self.facts.project, self.facts.symbol, self.facts.file_import)
        return self._envelope("file", {"subject": list(paths)}, rows, asked, order=["path"])

    def trace(self, root: str, depth: int = 12, inward: bool = False, most: int = walks.MOST_PATHS) -> Envelope:
        """All simple paths from a symbol over distinct callees; those out of scope are left out before leaves are told."""
        ends = ("to_id", "from_id") if inward else ("from_id", "to_id")
        place = self.facts.symbol.select(F.col("id").alias("dst"), F.col("path").alias("path"))
        pairs = self.facts.call_edge.select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst")).distinct().join(place, "dst", "left")
        inside, excluded = self._scoped(pairs)
        roots = self._resolve([root]).select("id").distinct()
        rows = walks.paths(inside.select("src", "dst"), roots, depth, most)
        walked = rows.select(F.explode("path").alias("dst")).union(roots).distinct()
        return self._envelope("trace", {"subject": root, "depth": depth}, rows, place.join(walked, "dst", "left_semi").select("path"), excluded)

    def changed_files(self, base: FactStore | None) -> DataFrame:
        """(path, change, excluded) between a baseline and the index; nothing is comparable without one."""
        f = self.facts
        if base is None:
            return f.file.select("path", F.lit(None).cast("string").alias("change"), F.lit(None).cast("string").alias("excluded")).limit(0)
        owners = f.file_project.select("path", "project", "canonical").union(base.file_project.select("path", "project", "canonical")).distinct()
        return upkeep.exclusions(maintain.snapshot_diff(base.file, f.file), owners, base.project, f.project)

    def impact(self, changed: DataFrame, depth: int = 12, absent: str | None = None) -> Envelope:
        """What depends on the symbols of changed files, with its first discoverer, kept by the scope of its own file.

        ``changed``: (path) or (path, change, excluded) as ``changed_files`` gives it; removed and excluded files start
        no walk. ``absent`` says why there is no baseline.
        """
        f = self.facts
        for name, value in (("change", "changed"), ("excluded", None)):
            if name not in changed.columns:
                changed = changed.withColumn(name, F.lit(value).cast("string"))
        changes = changed.select("path", "change", "excluded").distinct()
        calls = f.call_edge.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lit("calls").alias("kind"), F.lit(0).alias("rank"))
        refs = f.reference_edge.select("from_id", "to_id", "kind", F.lit(1))
        reached = walks.impact(calls.union(refs).distinct(), upkeep.seeds_of(changes, f.symbol), depth)
        # An id without a symbol is a file's own.
        place = f.symbol.select("id", F.col("path").alias("file"))
        rows, excluded = self._scoped(reached.join(place, "id", "left").withColumn("path", F.coalesce("file", "id")).drop("file"))
        spots = upkeep.impact_spots(changes, absent)
        return self._envelope("impact", {"depth": depth}, rows.drop("path"), changes.select("path"), excluded, ["depth", "id"], parts={"changes": changes, "spots": spots})

    def evidence(self, *subjects: str) -> Envelope:
        """Declarations, callers, callees and references of subjects, each kind cut to the limit by itself; their labels beside them."""
        ids = self._resolve(list(subjects)).select("id").distinct()
        f = self.facts

        def spot(df: DataFrame, kind: str, key: str, other: str) -> DataFrame:
            mine = df.join(ids.withColumnRenamed("id", key), key, "left_semi")
            return mine.select(F.lit(kind).alias("kind"), F.col(other).alias("id"), "path", "line")

        own = f.symbol.select("id", F.col("id").alias("_own"), "path", "line")
        parts = [spot(own, "declaration", "id", "_own"), spot(f.call_edge, "callers", "to_id", "from_id"), spot(f.call_edge, "callees", "from_id", "to_id"), spot(f.reference_edge, "references", "to_id", "from_id")]
        rows, excluded = self._scoped(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))
        totals = rows.groupBy("kind").agg(F.count("*").alias("available"))
        shown = rows
        if self.limit is not None:
            place = F.row_number().over(Window.partitionBy("kind").orderBy("id", "path", "line"))
            shown = rows.withColumn("_n", place).where(F.col("_n") <= self.limit).drop("_n")
            totals = totals.withColumn("returned", F.least("available", F.lit(self.limit)))
        else:
            totals = totals.withColumn("returned", F.col("available"))
        budgets = totals.withColumn("truncated", F.col("returned") < F.col("available"))
        paths = f.symbol.join(ids, "id", "left_semi").select(F.col("path").alias("node")).distinct()
        labels = L.effective(f.label).join(paths, "node", "left_semi")
        answer = self._envelope("evidence", {"subject": list(subjects)}, shown, rows.select("path"), excluded, ["kind", "id", "path", "line"], parts={"budgets": budgets, "labels": labels})
        answer.limit = None  # each kind has been cut already
        return answer

    def _doubts(self) -> DataFrame:
        dark = self.facts.file_project.where("canonical").join(self.facts.project.where("fidelity = 'syntactic'").select(F.col("config_path").alias("project")), "project", "left_semi").select("path", F.lit(True).alias("syntactic"))
        broken = self.facts.unresolved_specifier.select("path", F.lit(True).alias("broken")).distinct()
        return self.facts.file.select("path").join(dark, "path", "left").join(broken, "path", "left").fillna(False, ["syntactic", "broken"])

    def _judged(self, texts: DataFrame) -> DataFrame:
        f = self.facts
        pairs = claims.reach_pairs(texts)
        held = None
        if not pairs.isEmpty():
            held = walks.reaches(f.call_edge.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), pairs, 1000)
        return claims.evaluate(texts, f.symbol, f.call_edge, f.reference_edge, f.file_import, f.label, self._doubts(), held)

    def _named_files(self, texts: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, path): the files that claims name, by themselves or by a symbol."""
        arg = F.explode("p.args").alias("name")
        named = texts.select(*keys, claims.parse(F.col("text")).alias("p")).select(*keys, arg)
        by_symbol = named.join(self.facts.symbol.select(F.col("id").alias("name"), "path"), "name").select(*keys, "path")
        return by_symbol.union(named.join(self.facts.file.select(F.col("path").alias("name"), "path"), "name").select(*keys, "path")).distinct()

    def verify(self, texts: DataFrame) -> Envelope:
        """Verdicts on claims (``claim_no``, ``text``); ``reaches`` is walked, the others are joins. Contradicted ones fail."""
        rows = self._judged(texts)
        failing = rows.agg(F.count_if(F.col("verdict") == "contradicted"))
        return self._envelope("verify", {}, rows, self._named_files(texts, ["claim_no"]).select("path"), order=["claim_no"], failing=failing)

    def _sections(self, documents: DataFrame) -> DataFrame:
        """(doc, section, text) of documents that have a claim."""
        marked = documents.where(F.col("text").contains("<!-- claim:") | F.col("text").rlike(r"<!--\s*claim:"))
        lines = text_sources.lines_of(marked, "doc", "text")
        heads = text_sources.sections(lines).select("doc", "section", F.col("first").alias("pos"))
        along = Window.partitionBy("doc").orderBy("pos")
        placed = lines.join(heads.where("section > 0"), ["doc", "pos"], "left")
        placed = placed.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(along), F.lit(0).cast("long")))
        whole = F.array_sort(F.collect_list(F.struct("pos", "line")))
        return placed.groupBy("doc", "section").agg(F.array_join(F.transform(whole, lambda s: s["line"]), "\n").alias("text"))

    def docs_check(self, documents: DataFrame, changed: DataFrame | None = None, fail_on: tuple[str, ...] = ("contradicted",), known: DataFrame | None = None) -> Envelope:
        """Verdicts per document (``doc``, ``text`` of Markdown) from the claims and links in its sections.

        ``doc`` is the document's path, links are resolved from its folder; one is broken if neither a file nor a
        document (of ``documents`` or of ``known``: doc) is there. Where all holds but a file that a section names changed (``changed``: path), it is
        potentially stale. Documents whose verdict is in ``fail_on`` fail; faulty claims are counted beside.
        """
        f = self.facts
        sections = checkpoint(self._sections(documents))
        found = sections.select("doc", "section", F.posexplode(F.regexp_extract_all("text", F.lit(MARKER), F.lit(1))).alias("n", "text"))
        found = checkpoint(found.select("doc", "section", F.xxhash64("doc", "section", "n").alias("claim_no"), F.regexp_replace("text", r"\s+", " ").alias("text")))
        judged = checkpoint(self._judged(found.select("claim_no", "text")).drop("text").join(found, "claim_no"))
        target = sections.select("doc", "section", F.explode(text_sources.links(F.col("text"))).alias("target")).where(text_sources.is_repo_link(F.col("target")))
        folder = F.regexp_replace("doc", "[^/]*$", "")
        linked = target.select("doc", "section", text_sources.resolve(F.concat(folder, F.regexp_replace("target", "[#?].*$", ""))).alias("path")).distinct()
        there = f.file.select("path").union((documents if known is None else known).select(F.col("doc").alias("path"))).distinct().withColumn("there", F.lit(True))
        links = checkpoint(linked.join(there, "path", "left"))
        per_section = links.groupBy("doc", "section").agg(F.count("*").alias("links"), F.count_if(F.col("there").isNull()).alias("broken_links"))
        scope = self._named_files(found, ["doc", "section"]).union(links.where("there").select("doc", "section", "path")).distinct()
        moved = changed.select("path").distinct() if changed is not None else f.file.select("path").limit(0)
        touched = scope.join(moved, "path", "left_semi").select("doc", "section").distinct().withColumn("touched", F.lit(True))
        listed = sections.select("doc", "section").join(per_section, ["doc", "section"], "left").join(touched, ["doc", "section"], "left")
        listed = listed.fillna(0, ["links", "broken_links"]).fillna(False, ["touched"])
        verdicts = claims.section_verdicts(judged.where("NOT faulty"), listed)
        counts = judged.groupBy("doc").agg(F.count("*").alias("claims"), F.count_if("faulty").alias("faults"))
        rows = claims.document_verdicts(verdicts).join(counts, "doc").select("doc", "verdict", "claims", "faults", "covered", "sections")
        failing = rows.agg(F.count_if(F.col("verdict").isin(*fail_on)))
        return self._envelope("docs check", {}, rows, scope.select("path"), order=["doc"], failing=failing, parts={"sections": verdicts, "claims": judged, "links": links})

    def docs_affected(self, documents: DataFrame, changed: DataFrame, fail_on: tuple[str, ...] = ("contradicted",)) -> Envelope:
        """The documents with a claim about a file that changed, by name or by a symbol in it, checked."""
        args = F.explode(F.split(F.regexp_replace(F.array_join(F.regexp_extract_all("text", F.lit(MARKER), F.lit(1)), ","), r"[!()\s]", ","), ","))
        mentions = documents.select("doc", args.alias("name")).where("name <> ''").distinct()
        moved = self.facts.symbol.join(changed.select("path").distinct(), "path", "left_semi")
        names = moved.select(F.col("id").alias("name")).union(moved.select("qualified")).union(changed.select("path")).distinct()
        affected = mentions.join(names, "name", "left_semi").select("doc").distinct()
        answer = self.docs_check(documents.join(affected, "doc", "left_semi"), changed, fail_on, documents)
        answer.operation = "docs affected"
        return answer

    def draft(self, *subjects: str, most: int = 40) -> Envelope:
        """Claims that facts support about symbols and files, each once, by its first section: symbols, then their files' imports.

        A section has ``most`` claims at most and says how many were withheld.
        """
        f = self.facts
        named = self._subjects(list(subjects))
        ids = self._resolve(list(subjects)).select(F.col("id").alias("owner"), F.lit(0).alias("rank"))
        paths = named.join(f.file.select(F.col("path").alias("subject")), "subject", "left_semi").select(F.col("subject").alias("owner"), F.lit(1))
        owners = ids.union(paths).distinct()
        found = claims.from_facts(f.symbol, f.call_edge, f.reference_edge, f.file_import).join(owners, "owner")
        once = found.groupBy("claim").agg(F.min_by("owner", F.struct("rank", "owner")).alias("section"))
        place = F.row_number().over(Window.partitionBy("section").orderBy("claim"))
        rows = once.withColumn("n", place).groupBy("section").agg(
            F.concat_ws("\n", F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.concat(F.lit("<!-- claim: "), "claim", F.lit(" -->")))))).alias("markdown"),
            F.greatest(F.count("*") - most, F.lit(0)).alias("withheld"),
        )
        touched = f.symbol.join(ids.select(F.col("owner").alias("id")), "id", "left_semi").select("path").union(paths.select("owner"))
        return self._envelope("docs draft", {"subject": list(subjects)}, rows, touched, order=["section"])

    def doctor(self, stored: DataFrame | None = None, observed: DataFrame | None = None, remedies: list[tuple[str, str, str]] | None = None) -> Envelope:
        """Findings per (project, cause), with what can be done about them.

        ``remedies`` are rules (cause, regex of the project, command) of which the first that matches counts. With
        the ``stored`` and the ``observed`` signals of projects (``config_path`` and ``maintain.SIGNALS``), part
        ``signals`` says which agree.
        """
        owned = self.facts.unresolved_specifier.select("path", "specifier", "line", "cause").join(self.facts.file_project.where("canonical").select("path", "project"), "path")
        sites = owned.groupBy("project", "cause", "specifier").agg(F.count("*").alias("sites"))
        rows = sites.groupBy("project", "cause").agg(F.count("*").alias("specifiers"), F.sum("sites").alias("sites")).withColumn("remediable", F.col("cause").isin(*REMEDIABLE))
        remedy = F.lit(None).cast("string")
        for cause, pattern, command in reversed(remedies or []):
            remedy = F.when((F.col("cause") == cause) & F.col("project").rlike(pattern), F.lit(command)).otherwise(remedy)
        rows = rows.withColumn("remedy", F.when(F.col("remediable"), remedy))
        parts = {"signals": maintain.measure(stored, observed, "config_path")} if stored is not None and observed is not None else {}
        failing = rows.agg(F.count_if("remediable")) if remedies is not None else None
        return self._envelope("doctor", {}, rows, owned.select("path"), order=["project", "cause"], parts=parts, failing=failing)

    def analyse(self, walked: DataFrame | None = None, extract: Callable[[DataFrame], FactStore] | None = None, labelled: DataFrame | None = None, rules: list[tuple[str, str | None, str | None]] = (), baseline: Callable[[FactStore], DataFrame] | None = None) -> Envelope:
        """Counts of the index, after it was brought up to date.

        ``walked`` (path, content_hash, size, mtime_ms) is the tree as it is now, of which ``extract`` gives the facts of
        given files; what drifted, and importers of files whose export shape moved, wave by wave, are replaced.
        ``labelled`` (path, untracked, head) are the files to label by ``rules``. ``baseline`` keeps a copy. Each is left
        out where it isn't given; the operations that follow ask the new facts.
        """
        parts: dict[str, DataFrame] = {}
        if walked is not None and extract is not None:
            self.facts, parts["repair"] = repaired(self.facts, walked, extract)
        if labelled is not None:
            signals = L.signals(labelled, list(rules))
            certain = F.col("derivation").isin("user-config", "git-untracked", "generated-header")
            labels = signals.withColumn("provenance", F.when(certain, "deterministic").otherwise("inferred")).select("node", "axis", "value", "provenance", "derivation")
            self.facts = self.facts.with_relation("label", checkpoint(labels))
            parts["labels"] = self.facts.label.groupBy("axis", "value").agg(F.count("*").alias("n"))
        if baseline is not None:
            parts["capture"] = baseline(self.facts)
        f = self.facts
        counts = {"projects": f.project, "files": f.file, "symbols": f.symbol, "calls": f.call_edge, "unresolved": f.unresolved_call}
        rows = None
        for name, df in counts.items():
            part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
            rows = part if rows is None else rows.union(part)
        return self._envelope("analyse", {}, rows, f.file.select("path"), parts=parts)

    def changes(self, base: DataFrame, head: DataFrame) -> Envelope:
        """Files added, changed or removed between two snapshots."""
        rows = maintain.snapshot_diff(base, head)
        return self._envelope("changes", {}, rows, rows.select("path"), order=["path"])

    def report_bug(self, command: str, home: str = "") -> dict:
        """A report without private paths: counts, schema, and the command with the home folder cut out."""
        shown = re.sub(r"(?<![\w/])/(?:home|Users|root)(?:/[^\s/]+)?", "~", command.replace(home, "~") if home else command)
        return {"command": shown, "counts": {r["what"]: r["n"] for r in self.analyse().result.collect()}}


def unknown(operation: str) -> Envelope:
    return missing(operation, {}, "unknown-operation")
