"""Text sources on literals, and claims' decision table."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import atlas, claims, rollup
from loomgraph.sources import text as S


def lines(spark, *texts):
    return S.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc int, text string"), "doc", "text")


def test_git_log(spark):
    log = "@100 Ann B\n\n3\t1\tsrc/a.ts\n-\t-\timg.png\n@200 Cy\n\n5\t0\tsrc/a.ts\n1\t1\t\"q uoted\"\n"
    rows = [(r["path"], r["at"], r["author"], r["added"], r["deleted"]) for r in S.git_log(lines(spark, log, "1\t1\tno-header")).orderBy("doc", "pos").collect()]
    assert rows == [("src/a.ts", 100, "Ann B", 3, 1), ("img.png", 100, "Ann B", 0, 0), ("src/a.ts", 200, "Cy", 5, 0)]


def test_sections_and_fences(spark):
    md = "pre\n# A\ntext\n```js\n# no\n~~~\n```\n## B ##\n~~~~\n# no\n~~~\n# no\n~~~~~\n### C"
    rows = [(r["section"], r["heading"], r["first"]) for r in S.sections(lines(spark, md, "")).where("doc = 0").orderBy("section").collect()]
    assert rows == [(0, None, 0), (1, "A", 1), (2, "B", 7), (3, "C", 13)]


def test_paths_links_and_commands(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert [value(S.resolve(F.lit(p))) for p in ("a/./b/../c.ts", "../x", "a/../../x", "", "a//b")] == ["a/c.ts", "../x", "../x", "", "a/b"]
    assert value(S.links(F.lit("[a](x.md) ![b](<y z> 't') [c]()"))) == ["x.md", "y"]
    assert [value(S.is_repo_link(F.lit(t))) for t in ("a.md#x", "#x", "https://h", "//h/x", "mailto:z", "?q")] == [True, False, False, False, False, False]
    assert value(S.command_paths(F.lit("sed -n 1,2p 'a/b.ts'; cat x.mjs | head"))) == ["a/b.ts", "x.mjs"]
    assert value(S.command_paths(F.lit("tsc a/b.ts"))) == []
    assert [value(S.names_symbol(F.lit(t), "run")) for t in ("+function run() {", "-rerun()", "@@ run", " x.run")] == [True, False, False, True]


@pytest.mark.parametrize(
    "text,predicate,args,count,fault",
    [
        ("calls(a, b)", "calls", ["a", "b"], None, None),
        ("! calls(a,b)", "calls", ["a", "b"], None, None),
        ("callers(x) == 3", "callers", ["x"], 3, None),
        ("callers(x) == many", "callers", ["x"], None, "count-invalid"),
        ("callers(x)", "callers", ["x"], None, "count-invalid"),
        ("calls(a)", "calls", ["a"], None, "arity"),
        ("exports(a)", "exports", ["a"], None, "no-backend"),
        ("!onlyCalledBy(a, d/)", "onlyCalledBy", ["a", "d/"], None, "no-backend"),
        ("hums(a)", "hums", ["a"], None, "unknown-predicate"),
        ("hasLabel(a, role, blue)", "hasLabel", ["a", "role", "blue"], None, "label-invalid"),
        ("calls(a, b) maybe", "calls", ["a", "b"], None, "unparseable"),
        ("no claim", "", [""], None, "unparseable"),
    ],
)
def test_claim_parse(spark, text, predicate, args, count, fault):
    p = spark.createDataFrame([(text,)], "t string").select(claims.parse(F.col("t")).alias("p")).first()["p"]
    assert (p["predicate"], p["args"], p["count"], p["fault"]) == (predicate, args, count, fault)
    assert p["negated"] == text.startswith("!")


def test_decisions(spark):
    """present x negated x doubted, for claims of presence and of counts."""
    symbols = spark.createDataFrame([(i, p, True) for i, p in (("a", "ok.ts"), ("b", "ok.ts"), ("c", "dark.ts"), ("t", "ok.ts"))], "id string, path string, durable boolean")
    calls = spark.createDataFrame([("a", "t", "ok.ts"), ("c", "t", "dark.ts")], "from_id string, to_id string, path string")
    refs = spark.createDataFrame([], "from_id string, to_id string, kind string")
    imports = spark.createDataFrame([], "from_path string, to_path string")
    labels = spark.createDataFrame([], "node string, axis string, value string, provenance string, derivation string")
    doubts = spark.createDataFrame([("ok.ts", False, False), ("dark.ts", False, True)], "path string, syntactic boolean, broken boolean")
    want = {
        "calls(a, t)": ("verified", "holds"), "!calls(a, t)": ("contradicted", "falsified"), "calls(b, t)": ("contradicted", "falsified"), "!calls(b, t)": ("verified", "holds"),
        "calls(c, t)": ("verified", "holds"), "calls(c, b)": ("unable-to-verify", "unresolved-specifier"), "!calls(c, b)": ("unable-to-verify", "unresolved-specifier"),
        "callers(t) == 2": ("verified", "holds"), "callers(t) == 3": ("contradicted", "count-differs"), "callers(c) == 0": ("unable-to-verify", "unresolved-specifier"),
        "exists(zz)": ("unable-to-verify", "unresolved"), "!exists(zz)": ("verified", "holds"), "exists(a)": ("verified", "holds"), "calls(a, zz)": ("unable-to-verify", "unresolved"),
        "onlyCalledBy(t, ok.ts)": ("contradicted", "falsified"), "sings(a)": (None, "unknown-predicate"),
    }
    texts = spark.createDataFrame(list(enumerate(want)), "claim_no long, text string")
    got = {r["text"]: (r["verdict"], r["reason"]) for r in claims.evaluate(texts, symbols, calls, refs, imports, labels, doubts).collect()}
    assert got == want


def test_timeline_and_grades(spark):
    frames = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (2, "b")], "frame int, path string")
    assert {r["path"]: (r["birth"], r["death"]) for r in atlas.lifetimes(frames, ["path"], "frame").collect()} == {"a": (0, 2), "b": (1, 3)}
    runs = spark.createDataFrame([("x", "partial"), ("x", "correct"), ("y", "correct"), ("y", "correct"), ("y", "incorrect"), ("z", None)], "k string, grade string")
    assert {r["k"]: (r["grade"], r["votes"], r["of"]) for r in rollup.modal(runs, ["k"], "grade").collect()} == {"x": ("partial", 1, 2), "y": ("correct", 2, 3)}
    cases = spark.createDataFrame([(150.0, 100.0), (99.5, 100.0), (1.0, 0.0)], "a double, r double")
    assert [r["p"] for r in cases.select(rollup.percent(F.col("a"), F.col("r")).alias("p")).collect()] == ["+50%", "0%", "—"]
