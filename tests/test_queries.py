"""Every registered graph query against SQL on the smallest tables."""

import os

import duckdb
import pytest

from loomgraph.plans.registry import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, list) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR).toArrow()
    if name not in ORACLE:
        assert got.num_rows > 0
        return
    want = con.sql(ORACLE[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    rows = lambda t: sorted(tuple(shown(r[c]) for c in columns) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_llm_is_not_needed():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "loomgraph"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import) loomgraph\.llm", p.read_text()), p


def test_entry_without_what_the_corpus_operators_import():
    """Where a package that they need is missing, the graph queries are still there."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['tiktoken'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))]
