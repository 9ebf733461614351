"""Operations put together from operators, on a small repository."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph import sinks
from loomgraph.api import Operations
from loomgraph.facts import FactStore, baselines, repaired
from loomgraph.functions.text import canonical_json
from loomgraph.operators import labels, maintain, network, upkeep, walks
from loomgraph.schema import SCHEMAS
from loomgraph.sources import records
from loomgraph.sources.discovery import repository_root
from loomgraph.streaming import drift


@pytest.fixture(scope="module")
def repo(spark):
    """a -> b -> c by calls; d stands alone in a syntactic project; e imports c."""
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    files = {"a": "src/a.ts", "b": "src/b.ts", "c": "src/c.ts", "d": "old/d.ts", "e": "src/e.ts"}
    symbol = lambda i: (i, files[i], i, i, i, "function", 10, 1, True, True, 0)
    call = lambda x, y, line: (x, y, "symbol", files[x], line, "deterministic", "checker")
    return FactStore(
        spark,
        {
            "project": make("project", [("tsconfig.json", "typed", 4, "2026-01-01", "f", None, False), ("old/tsconfig.json", "syntactic", 1, "2026-01-01", "f", "unprepared", False)]),
            "file": make("file", [(p, f"h{k}", 1, 0.0, f"s{k}") for k, p in files.items()]),
            "seen_file": make("seen_file", [(p,) for p in files.values()]),
            "file_project": make("file_project", [(p, "old/tsconfig.json" if k == "d" else "tsconfig.json", True) for k, p in files.items()]),
            "symbol": make("symbol", [symbol(i) for i in files]),
            "call_edge": make("call_edge", [call("a", "b", 3), call("a", "b", 4), call("b", "c", 5)]),
            "reference_edge": make("reference_edge", [("a", "c", "references", files["a"], 7, "deterministic", "heritage-clause")]),
            "file_import": make("file_import", [("src/e.ts", "./c", "src/c.ts"), ("src/a.ts", "./b", "src/b.ts"), ("src/b.ts", "./c", "src/c.ts")]),
            "label": make("label", [("src/a.ts", "role", "test", "inferred", "path-convention"), ("src/e.ts", "authorship", "generated", "deterministic", "generated-header")]),
            "unresolved_specifier": make("unresolved_specifier", [("old/d.ts", "./gone", 2, "unprepared"), ("old/d.ts", "lib", 3, "broken")]),
        },
    )


def test_reaches_is_doubted_like_other_absences(repo, spark):
    texts = ["reaches(a, c)", "reaches(c, a)", "!reaches(c, a)", "!reaches(a, c)", "reaches(a, d)", "reaches(d, a)", "!reaches(a, d)", "reaches(a, nowhere)", "calls(a, d)"]
    answer = Operations(repo, include={}).verify(spark.createDataFrame(list(enumerate(texts)), "claim_no long, text string"))
    got = {r["text"]: (r["verdict"], r["reason"]) for r in answer.result.collect()}
    assert got == {
        "reaches(a, c)": ("verified", "holds"),
        "reaches(c, a)": ("contradicted", "falsified"),
        "!reaches(c, a)": ("verified", "holds"),
        "!reaches(a, c)": ("contradicted", "falsified"),
        "reaches(a, d)": ("unable-to-verify", "syntactic"),
        "reaches(d, a)": ("unable-to-verify", "syntactic"),
        "!reaches(a, d)": ("unable-to-verify", "syntactic"),
        "reaches(a, nowhere)": ("unable-to-verify", "unresolved"),
        "calls(a, d)": ("unable-to-verify", "syntactic"),
    }
    assert answer.exit_code() == 1
    good = Operations(repo, include={}).verify(spark.createDataFrame([(1, "calls(a, b)")], "claim_no long, text string"))
    assert good.exit_code() == 0 and good.conditions.count() == 0 and good.blind_spots.count() == 0


def test_answers_say_what_they_touched(repo):
    ops = Operations(repo, include={})
    near = ops.trace("a")
    assert [">".join(r["path"]) for r in near.result.collect()] == ["a>b>c"]
    assert near.conditions.count() == 0 and near.blind_spots.count() == 0
    far = ops.trace("d")
    assert [r["cause"] for r in far.conditions.collect()] == ["unprepared"] and far.blind_spots.count() == 2
    with pytest.raises(walks.TooManyPaths):
        ops.trace("a", most=0)


def test_impact_against_a_baseline(repo, spark):
    changed = repo.file.withColumn("content_hash", F.when(F.col("path") == "src/c.ts", F.lit("old")).otherwise(F.col("content_hash")))
    base_files = changed.where("path <> 'src/e.ts'").union(spark.createDataFrame([("src/gone.ts", "g", 1, 0.0, "s")], SCHEMAS["file"]))
    base_files = base_files.withColumn("content_hash", F.when(F.col("path") == "old/d.ts", F.lit("old")).otherwise(F.col("content_hash")))
    base = FactStore(spark, dict(repo.relations) | {"file": base_files, "project": repo.project.withColumn("fidelity", F.lit("typed"))})
    ops = Operations(repo)
    found = ops.changed_files(base)
    assert {r["path"]: (r["change"], r["excluded"]) for r in found.collect()} == {"src/c.ts": ("changed", None), "src/e.ts": ("added", None), "src/gone.ts": ("removed", None), "old/d.ts": ("changed", "fidelity-changed")}
    answer = ops.impact(found)
    assert [(r["id"], r["depth"], r["through"], r["source"]) for r in answer.result.collect()] == [("c", 0, "changed", None), ("a", 1, "references", "c"), ("b", 1, "calls", "c")]
    assert answer.excluded.first()[0] == 1  # e is generated
    assert [tuple(r) for r in answer.parts["spots"].collect()] == [("old/d.ts", "fidelity-changed")]
    none = ops.impact(ops.changed_files(None), absent="none-stored")
    assert none.result.count() == 0 and [tuple(r) for r in none.parts["spots"].collect()] == [("baseline", "none-stored")]


def test_evidence_is_cut_kind_by_kind(repo):
    answer = Operations(repo, include={}, limit=1).evidence("a", "b")
    rows = [(r["kind"], r["id"]) for r in answer.result.collect()]
    assert rows == [("callees", "b"), ("callers", "a"), ("declaration", "a")]
    assert {r["kind"]: (r["available"], r["returned"], r["truncated"]) for r in answer.parts["budgets"].collect()} == {"callees": (3, 1, True), "callers": (2, 1, True), "declaration": (2, 1, True)}
    assert [(r["node"], r["value"]) for r in answer.parts["labels"].collect()] == [("src/a.ts", "test")]


def test_documents_are_checked_by_section(repo, spark):
    text = "<!-- claim: calls(a, b) -->\nintro [code](../src/a.ts#L1)\n# One\n<!-- claim: calls(b,\n c) -->\n# Two\n[lost](./nowhere.md) [out](https://x.example/)\n```\n# not a heading\n```\n# Three\nplain\n"
    docs = spark.createDataFrame([("docs/x.md", text), ("docs/y.md", "# Y\n<!-- claim: calls(a, b) --> [x](x.md)"), ("docs/z.md", "no claim [x](./none.md)"), ("docs/w.md", "<!-- claim: nonsense -->\n<!-- claim: calls(c, a) -->")], "doc string, text string")
    ops = Operations(repo, include={})
    answer = ops.docs_check(docs)
    got = {r["doc"]: (r["verdict"], r["claims"], r["faults"], r["covered"], r["sections"]) for r in answer.result.collect()}
    assert got == {"docs/x.md": ("contradicted", 2, 0, 2, 4), "docs/y.md": ("verified", 1, 0, 1, 1), "docs/w.md": ("contradicted", 2, 1, 1, 1)}
    assert {(r["doc"], r["section"]): r["verdict"] for r in answer.parts["sections"].where("doc = 'docs/x.md'").collect()} == {("docs/x.md", 0): "verified", ("docs/x.md", 1): "verified", ("docs/x.md", 2): "contradicted", ("docs/x.md", 3): None}
    assert answer.exit_code() == 1 and ops.docs_check(docs.where("doc = 'docs/y.md'"), known=docs).exit_code() == 0
    moved = repo.file.where("path = 'src/b.ts'")
    stale = ops.docs_check(docs.where("doc = 'docs/y.md'"), moved, fail_on=("contradicted", "potentially-stale"), known=docs)
    assert stale.result.first()["verdict"] == "potentially-stale" and stale.exit_code() == 1
    affected = ops.docs_affected(docs, repo.file.where("path = 'src/c.ts'"))
    assert [(r["doc"], r["verdict"]) for r in affected.result.collect()] == [("docs/w.md", "contradicted"), ("docs/x.md", "contradicted")]


def test_doctor_measures_and_advises(repo, spark):
    signals = ", ".join(f"{s} string" for s in maintain.SIGNALS)
    kind = f"config_path string, {signals}"
    stored = spark.createDataFrame([("old/tsconfig.json", "1", "0", "l", "o", "g", "d")], kind)
    seen = spark.createDataFrame([("old/tsconfig.json", "1", "0", "L", "o", "g", None)], kind)
    answer = Operations(repo).doctor(stored, seen, [("unprepared", "^apps/", "build"), ("unprepared", "", "install"), ("unprepared", "^old", "never")])
    assert {r["cause"]: (r["remediable"], r["remedy"]) for r in answer.result.collect()} == {"broken": (False, None), "unprepared": (True, "install")}
    assert [r["signal"] for r in answer.parts["signals"].where("NOT agrees").collect()] == ["lockfile", "declarations"]
    assert answer.exit_code() == 1 and [r["cause"] for r in answer.conditions.collect()] == ["unprepared"]


def test_draft_withholds_beyond_its_bound(repo):
    rows = {r["section"]: r for r in Operations(repo).draft("a", "src/a.ts", most=1).result.collect()}
    assert rows["a"]["withheld"] == 2 and rows["a"]["markdown"].count("claim:") == 1
    assert rows["src/a.ts"]["markdown"] == "<!-- claim: imports(src/a.ts, src/b.ts) -->" and rows["src/a.ts"]["withheld"] == 0


def test_analyse_repairs_labels_and_captures(repo, spark, tmp_path):
    walked = repo.file.drop("export_shape_hash").where("path <> 'old/d.ts'").withColumn("content_hash", F.when(F.col("path") == "src/c.ts", F.lit("new")).otherwise(F.col("content_hash")))
    walked = walked.withColumn("size", F.when(F.col("path") == "src/c.ts", F.lit(9)).otherwise(F.col("size")).cast("long"))
    asked = []

    def extract(paths):
        names = sorted(r["path"] for r in paths.collect())
        asked.append(names)
        mine = lambda name, key: getattr(repo, name).where(F.col(key).isin(*names)) if names else getattr(repo, name).limit(0)
        file = mine("file", "path").withColumn("content_hash", F.when(F.col("path") == "src/c.ts", F.lit("new")).otherwise(F.col("content_hash")))
        file = file.withColumn("export_shape_hash", F.when(F.col("path") == "src/c.ts", F.lit("other")).otherwise(F.col("export_shape_hash")))
        keys = {"symbol": "path", "call_edge": "path", "reference_edge": "path", "file_import": "from_path", "file_project": "path", "unresolved_specifier": "path", "label": "node"}
        return FactStore(spark, {"file": file} | {n: mine(n, k) for n, k in keys.items()})

    ops = Operations(repo, include=["authorship=authored"])
    files = spark.createDataFrame([("src/c.ts", False, "// @generated"), ("src/a.test.ts", True, "")], "path string, untracked boolean, head string")
    known = spark.createDataFrame([("c0",)], "commit_id string")
    keep = lambda commit, at: lambda facts: facts.capture(str(tmp_path / "base"), commit, known, 2, at)
    answer = ops.analyse(walked, extract, files, [(r"^src/c", "config", None)], keep("c0", "2026-01-01"))
    # c changed; its importers b and e follow, as its exports moved; theirs didn't, so nothing else does.
    assert asked == [["src/c.ts"], ["src/b.ts", "src/e.ts"]]
    assert {r["path"]: r["wave"] for r in answer.parts["repair"].collect()} == {"src/c.ts": 0, "src/b.ts": 1, "src/e.ts": 1}
    assert {r["what"]: r["n"] for r in answer.result.collect()} == {"projects": 2, "files": 4, "symbols": 4, "calls": 3, "unresolved": 0}
    assert {r["value"]: r["n"] for r in answer.parts["labels"].where("axis = 'role'").collect()} == {"source": 2, "test": 1, "config": 1}
    assert [tuple(r) for r in answer.parts["capture"].collect()] == [("c0", False)]
    for commit, at in (("c1", "2026-01-02"), ("c2", "2026-01-03")):
        last = ops.analyse(baseline=keep(commit, at)).parts["capture"]
    # c1 is no ancestor of c2, so it leaves before the older c0.
    assert {r["commit_id"]: r["evicted"] for r in last.collect()} == {"c0": False, "c1": True, "c2": False}
    assert [tuple(r) for r in baselines(spark, str(tmp_path / "base")).orderBy("commit_id").collect()] == [("c0", "2026-01-01"), ("c2", "2026-01-03")]
    again, done = repaired(repo, repo.file, extract)
    assert done.count() == 0 and again.file.count() == 5


def test_saving_over_what_was_loaded(repo, spark, tmp_path):
    at = str(tmp_path / "index")
    repo.save(at)
    loaded = FactStore.load(spark, at)
    once = FactStore(spark, {n: getattr(loaded, n).where("path <> 'src/e.ts'") for n in ("file", "symbol")} | {n: getattr(loaded, n) for n in loaded.relations if n not in ("file", "symbol")})
    once.save(at)
    assert FactStore.load(spark, at).file.count() == 4 and loaded.file.count() == 5
    for _ in range(2):
        FactStore.load(spark, at).save(at)
    assert len([p for p in (tmp_path / "index").iterdir() if p.is_dir()]) == 2
    rows = spark.createDataFrame([("src/a.ts", "new", 1, 0.0, "s", 2), ("src/a.ts", "old", 1, 0.0, "s", 1)], SCHEMAS["file"] + ", at int")
    FactStore(spark, {"file": rows}).save(str(tmp_path / "dup"), order="at")
    assert [r["content_hash"] for r in FactStore.load(spark, str(tmp_path / "dup")).file.collect()] == ["new"]


def test_filters_are_closed(repo):
    assert labels.filters(["role=test", "authorship=generated"]) == {"role": "test", "authorship": "generated"}
    for bad in ("role", "role=tests", "kind=test", "role=test=1"):
        with pytest.raises(ValueError):
            Operations(repo, include=[bad])
    with pytest.raises(ValueError):
        Operations(repo, exclude={"authorship": "robot"})


def test_text_for_readers(repo):
    shown = Operations(repo, include={}).callers("b").to_text(1).split("\n")
    assert len(shown) == 2 and shown[1] == "and 1 more"


def test_records_of_both_generations(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"caseId": "1", "arm": "baseline", "replicate": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"caseId": "2", "arm": {"id": "tool/x", "toolset": "tool", "model": "x"}, "replicate": 2}, indent=1))
    rows = {r["caseId"]: tuple(r["arm"]) for r in records.read_records(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("baseline/unknown", "baseline", "unknown"), "2": ("tool/x", "tool", "x")}


def test_roots_and_canonical_json(tmp_path):
    deep = tmp_path / "r" / "p" / "q"
    deep.mkdir(parents=True)
    (tmp_path / "r" / "p" / "package.json").write_text("{}")
    assert repository_root(str(deep)) == str(tmp_path / "r" / "p")
    (tmp_path / "r" / ".git").write_text("gitdir: x")
    assert repository_root(str(deep)) == str(tmp_path / "r")
    assert canonical_json({"b": [1, {"d": None, "c": "é"}], "a": True}) == '{"a":true,"b":[1,{"c":"é","d":null}]}'


def test_sinks(repo, spark, tmp_path):
    rows = {r["path"]: r for r in sinks.atlas_files(repo).collect()}
    assert len(rows) == 5 and (rows["src/b.ts"]["calls_in"], rows["src/b.ts"]["calls_out"], rows["src/c.ts"]["refs_in"]) == (2, 1, 1)
    assert rows["src/a.ts"]["role"] == "test" and rows["src/e.ts"]["generated"] and rows["old/d.ts"]["project"] == "old/tsconfig.json" and rows["old/d.ts"]["kinds"][0] == 1
    assert [tuple(r) for r in sinks.atlas_links(repo, 1).collect()] == [("calls", "src/a.ts", "src/b.ts", 2), ("imports", "src/a.ts", "src/b.ts", 1)]
    inner = FactStore(spark, {"symbol": spark.createDataFrame([(q, "src/a.ts", q, q, q.split(".")[-1], "function", s, 1, True, True, 0) for q, s in (("k.m", 20), ("k", 10), ("z", 30))], SCHEMAS["symbol"])})
    one = sinks.names(inner).first()
    assert (one["names"], one["parents"]) == (["k", "m", "z"], [-1, 0, -1])
    frames = spark.createDataFrame([(0, "a", 1), (0, "b", 5), (2, "a", 7)], "frame int, path string, size long")
    assert {r["path"]: (r["birth"], r["death"], r["size"]) for r in sinks.timeline(frames).collect()} == {"a": (0, 3, 7), "b": (0, 1, 5)}
    sinks.write(str(tmp_path), files=sinks.atlas_files(repo), names=sinks.names(repo))
    assert spark.read.json(str(tmp_path / "files")).count() == 5


def test_streamed_batches_see_what_earlier_ones_left(spark, tmp_path):
    index = spark.createDataFrame([("a", "1", 1, 1.0)], drift.OBSERVED)
    found = []
    note = lambda df, n: found.append(sorted((r["path"], r["state"]) for r in df.collect()))
    for k, rows in enumerate(([("a", "2", 2, 2.0), ("b", "1", 1, 2.0)], [("a", "1", 1, 3.0)], [("a", "1", 1, 4.0), ("b", None, None, 4.0)], [("b", "1", 1, 5.0)])):
        spark.createDataFrame(rows, drift.OBSERVED).coalesce(1).write.mode("append").parquet(str(tmp_path / "seen"))
        drift.follow(spark, str(tmp_path / "seen"), index, note, str(tmp_path / "cp")).awaitTermination(60)
    assert found == [[("a", "changed"), ("b", "added")], [("a", "changed")], [("b", "deleted")], [("b", "added")]]


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id % 5 AS v").repartition(7)
    got = {r["k"]: r["s"] for r in network.running(df, ["k"], "v", "s").collect()}
    rows = sorted((i * 7919 % 1000, i % 5) for i in range(1000))
    total = 0
    for k, v in rows:
        total += v
        assert got[k] == total


def test_stale_reasons_come_in_order(repo, spark):
    meta = spark.createDataFrame([("schemaVersion", "1"), ("toolVersion", "2")], "key string, value string")
    assert upkeep.stale_reason(meta, repo.symbol, "2", "6").first()[0] == "compiler"
    assert upkeep.stale_reason(meta, repo.symbol.limit(0), "3", "6").first()[0] == "empty"


def test_communities_paths_and_folders(spark):
    """Values of the measures that SQL doesn't give."""
    ring = lambda names: [(x, y, 3) for x in names for y in names if x < y]
    links = spark.createDataFrame(ring("abcd") + ring("efgh") + [("d", "e", 1)], "a string, b string, n long")
    regions = spark.createDataFrame([(p, 1) for p in "abcdefgh"] + [("z", 2)], "path string, region long")
    got = {r["path"]: (r["region"], r["community"]) for r in network.label_propagation(links, regions).collect()}
    assert got == {p: (1, 0) for p in "abcd"} | {p: (1, 1) for p in "efgh"} | {"z": (2, 0)}
    chain = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("c", "d", 1), ("a", "x", 1), ("x", "y", 1), ("b", "a", 9)], "a string, b string, n long")
    weight = spark.createDataFrame([("a", 10.0), ("b", 9.0), ("x", 1.0)], "id string, centrality double")
    assert [r["path"] for r in network.dependency_paths(chain, weight).collect()][0] == "a>b>c>d"
    paths = spark.createDataFrame([(f"apps/{d}/f{i}.ts",) for d, n in (("web", 40), ("api", 30), ("cli", 25)) for i in range(n)] + [("README.ts",)], "path string")
    assert [(r["prefix"], r["n"]) for r in network.subsystems(paths).collect()] == [("apps/web", 40), ("apps/api", 30), ("apps/cli", 25)]


def test_clone_links_of_a_line_that_all_have(spark):
    from loomgraph.operators import atlas

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = [f"d{i:03d}" for i in range(300)]
        groups = spark.createDataFrame([("hot", d, 1) for d in docs] + [("cold", d, 1) for d in docs[:3]] + [("lone", "d001", 2)], "h string, doc string, n long")
        got = {(r["a"], r["b"]): r["lines"] for r in atlas.clone_links(groups, 1000).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = dict.fromkeys(zip(docs[:-1], docs[1:], strict=True), 1)
    want |= {(docs[0], docs[1]): 2, (docs[1], docs[2]): 2}
    assert got == want
