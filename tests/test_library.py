"""Ids, configuration, facts as files, operations, envelopes, streams."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomgraph import ids
from loomgraph.api import Operations, unknown
from loomgraph.facts import FactStore
from loomgraph.functions.patterns import config_glob, path_glob, symbol_glob
from loomgraph.operators import maintain
from loomgraph.schema import ENUMS, SCHEMAS
from loomgraph.sources import config
from loomgraph.streaming import drift

SYMBOLS = [("alpha", "src/a.ts", "alpha", "alpha", 1), ("inner", "src/a.ts", "alpha.inner", "inner", 3), ("beta", "src/b.ts", "beta", "beta", 9)]


@pytest.fixture(scope="module")
def store(spark):
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    return FactStore(
        spark,
        {
            "project": make("project", [("tsconfig.json", "typed", 2, "2026-01-01", "f", "missing-generated", False)]),
            "file": make("file", [("src/a.ts", "a", 1, 0.0, "sa"), ("src/b.ts", "b", 1, 0.0, "sb")]),
            "file_project": make("file_project", [("src/a.ts", "tsconfig.json", True), ("src/b.ts", "tsconfig.json", True)]),
            "symbol": make("symbol", [(i, p, q, q, n, "function", line * 10, line, True, True, 0) for i, p, q, n, line in SYMBOLS]),
            "call_edge": make("call_edge", [("beta", "alpha", "symbol", "src/b.ts", 9, "deterministic", "checker"), ("src/b.ts", "alpha", "file", "src/b.ts", 3, "deterministic", "checker"), ("alpha", "inner", "symbol", "src/a.ts", 2, "syntactic", "checker")]),
            "reference_edge": make("reference_edge", [("beta", "alpha", "typeReferences", "src/b.ts", 11, "deterministic", "heritage-clause")]),
            "file_import": make("file_import", [("src/b.ts", "./a.ts", "src/a.ts"), ("src/b.ts", "./gone.ts", None)]),
            "unresolved_specifier": make("unresolved_specifier", [("src/a.ts", "./gen", 4, "missing-generated")]),
            "label": make("label", [("src/a.ts", "authorship", "generated", "inferred", "codegen-path")]),
        },
    )


def test_operations(store):
    ops = Operations(store)
    callers = ops.callers("alpha")
    assert [(r["from_id"], r["line"]) for r in callers.result.collect()] == [("beta", 9), ("src/b.ts", 3)]
    assert [r["cause"] for r in callers.conditions.collect()] == ["missing-generated"]
    assert ops.callees("alpha").result.count() == 0 and ops.callees("alpha").excluded.first()[0] == 1
    assert Operations(store, include={}).callees("alpha").result.count() == 1
    assert [">".join(r["path"]) for r in Operations(store, include={}).trace("beta").result.collect()] == ["beta>alpha>inner"]
    assert [">".join(r["path"]) for r in ops.trace("beta").result.collect()] == ["beta"]
    assert ops.references("alpha").result.count() == 1
    assert [r["id"] for r in ops.symbol("*a").result.collect()] == ["beta"]
    report = ops.file("b.ts").result.first()
    assert (report["imports"], report["broken"], report["symbols"], report["projects"]) == (2, 1, 1, "tsconfig.json")
    changed = store.file.where("path = 'src/a.ts'")
    assert [(r["id"], r["depth"]) for r in Operations(store, include={}).impact(changed).result.collect()] == [("alpha", 0), ("inner", 0), ("beta", 1), ("src/b.ts", 1)]
    # Like other answers, an impact keeps to its scope: symbols of the generated file are counted, not listed.
    scoped = ops.impact(changed)
    assert [r["id"] for r in scoped.result.collect()] == ["beta", "src/b.ts"] and scoped.excluded.first()[0] == 2
    assert {r["kind"] for r in Operations(store, include={}).evidence("alpha").result.collect()} == {"declaration", "callers", "callees", "references"}
    assert {r["what"]: r["n"] for r in ops.analyse().result.collect()} == {"projects": 1, "files": 2, "symbols": 3, "calls": 3, "unresolved": 0}
    assert ops.doctor().result.first()["remediable"]
    assert "imports" not in ops.draft("beta").result.first()["markdown"] and "calls(beta, alpha)" in ops.draft("beta").result.first()["markdown"]
    assert ops.report_bug("run /home/me/x --fast")["command"] == "run ~/x --fast"


def test_claims_in_documents(store, spark):
    ops = Operations(store, include={})
    docs = spark.createDataFrame([("good.md", "<!-- claim: calls(beta,\n alpha) --> <!-- claim: reaches(beta, inner) -->"), ("bad.md", "<!-- claim: !calls(beta, alpha) -->"), ("odd.md", "<!-- claim: sings(beta) -->"), ("none.md", "text")], "doc string, text string")
    got = {r["doc"]: (r["verdict"], r["claims"], r["faults"]) for r in ops.docs_check(docs).result.collect()}
    assert got == {"good.md": ("verified", 2, 0), "bad.md": ("contradicted", 1, 0), "odd.md": (None, 1, 1)}
    affected = ops.docs_affected(docs, store.file.where("path = 'src/b.ts'")).result.collect()
    assert {r["doc"] for r in affected} == {"good.md", "bad.md", "odd.md"}


def test_envelope(store):
    answer = json.loads(Operations(store, limit=1).callers("alpha").to_json())
    assert answer["budget"] == {"returned": 1, "available": 2, "truncated": True} and len(answer["result"]) == 1
    assert unknown("x").exit_code() == 2 and Operations(store).doctor().exit_code() == 0
    once, twice = (Operations(store).references("alpha").to_json() for _ in range(2))
    assert once == twice


def test_facts_round_trip_and_wave(store, spark, tmp_path):
    for form in ("parquet", "json"):
        store.save(str(tmp_path / form), form)
        again = FactStore.load(spark, str(tmp_path / form), form)
        for name in store.relations:
            assert again.relations[name].exceptAll(store.relations[name]).where("1 = 1").count() <= (1 if name == "meta" else 0), name
    assert store.faults().count() == 0
    bad = FactStore(spark, {"project": spark.createDataFrame([("x", "guessed", 0, "", "", None, False)], SCHEMAS["project"])})
    assert [(r["relation"], r["value"]) for r in bad.faults().collect()] == [("project", "guessed")]
    # Incremental equals full: replacing b.ts by itself changes nothing.
    one = FactStore(spark, {n: getattr(store, n).where("path = 'src/b.ts'") for n in ("file", "symbol", "call_edge", "reference_edge", "file_project", "unresolved_specifier")} | {"file_import": store.file_import})
    after = store.apply_wave(one, store.file.limit(0).select("path"))
    for name in ("file", "symbol", "call_edge", "reference_edge", "file_import", "file_project"):
        a, b = getattr(after, name), getattr(store, name)
        assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count(), name


def test_enum_order_is_fixed():
    assert ENUMS["kind"][0] == "function" and ENUMS["provenance"] == ("deterministic", "syntactic", "inferred") and ENUMS["precondition"][2:] == ("unmapped", "broken")


names = st.text(st.characters(codec="utf-8", exclude_characters="\0"), min_size=1, max_size=12)


@given(st.lists(st.tuples(names, st.sampled_from(sorted(ids.SUFFIX))), min_size=1, max_size=4), st.sampled_from(["a b", "npm", ""]))
def test_ids_round_trip(parts, manager):
    text = ids.build(manager, "pkg", "1.0", "src/x y.ts", "".join(ids.descriptor(n, k) for n, k in parts))
    found = ids.parse(text)
    assert found and found.path == "src/x y.ts" and found.names == tuple(n for n, _ in parts) and found.manager == manager


def test_ids_as_columns(spark):
    one = ids.build("npm", "p", "1", "src/a.ts", ids.descriptor("A", "class") + ids.descriptor("b c", "method"))
    rows = spark.createDataFrame([(one,), ("junk",), (None,)], "id string").select(ids.parse_column("id").alias("p")).select("p.*").collect()
    assert tuple(rows[0]) == ("src/a.ts", "A#`b c`().", "A.b c", "src/a.ts#A.b c") and rows[1]["path"] is None and rows[2]["path"] is None


def test_globs():
    import re

    assert re.match(symbol_glob("a*?"), "a/b") and not re.match(symbol_glob("a?"), "a")
    assert re.match(path_glob("**/x/*.ts"), "x/a.ts") and re.match(path_glob("**/x/*.ts"), "p/q/x/a.ts") and not re.match(path_glob("*.ts"), "a/b.ts")
    assert re.match(config_glob("src"), "src/a/b.ts") and not re.match(config_glob("src"), "srcs/a.ts")


def test_configuration():
    assert config.read_jsonc('{"a": "x//y /* */,]", // c\n "b": [1, 2, /* z */], }') == {"a": "x//y /* */,]", "b": [1, 2]}
    read = {"t/a.json": '{"extends": "../base", "compilerOptions": {"x": 1}, "include": ["src"]}', "base.json": '{"compilerOptions": {"x": 0, "y": 2}, "exclude": ["dist"]}'}
    assert config.read_project("t/a.json", read.__getitem__) == {"compilerOptions": {"x": 1, "y": 2}, "exclude": ["dist"], "include": ["src"]}
    with pytest.raises(ValueError):
        config.read_project("a.json", {"a.json": '{"extends": "./a.json"}'}.__getitem__)


def test_drift_states(spark):
    kind = "path string, content_hash string, size long, mtime_ms double"
    old = spark.createDataFrame([("same", "h", 1, 1.0), ("touched", "h", 1, 1.0), ("edited", "h", 1, 1.0), ("gone", "h", 1, 1.0)], kind)
    new = spark.createDataFrame([("same", "other", 1, 1.0), ("touched", "h", 1, 2.0), ("edited", "g", 2, 2.0), ("new", "h", 1, 1.0), ("ignored", "h", 1, 1.0)], kind)
    seen = spark.createDataFrame([("ignored",)], "path string")
    assert {r["path"]: r["state"] for r in maintain.drift(old, new, seen).collect()} == {"edited": "changed", "gone": "deleted", "new": "added"}


def test_streams(spark, tmp_path):
    index = spark.createDataFrame([("a", "1", 1, 1.0), ("b", "1", 1, 1.0)], drift.OBSERVED)
    spark.createDataFrame([("a", "2", 2, 2.0), ("b", None, None, 3.0), ("c", "1", 1, 1.0)], drift.OBSERVED).write.parquet(str(tmp_path / "seen"))
    found = []
    query = drift.follow(spark, str(tmp_path / "seen"), index, lambda df, n: found.extend((r["path"], r["state"]) for r in df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sorted(found) == [("a", "changed"), ("b", "deleted"), ("c", "added")]
    spark.createDataFrame([("2026-01-01 00:10:00", "x", "user", "hello"), ("2026-01-01 00:20:00", "x", "user", "you")], "ts string, conv_id string, role string, text string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "conv_id", "role", "text").write.parquet(str(tmp_path / "turns"))
    stream = drift.tally(spark.readStream.schema("ts timestamp, conv_id string, role string, text string").parquet(str(tmp_path / "turns")))
    q = stream.writeStream.format("memory").queryName("tally").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["conv_id"], r["turns"], r["chars"]) for r in spark.table("tally").collect()] == [("x", 2, 8)]
