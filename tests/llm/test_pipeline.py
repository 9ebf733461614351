from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomgraph.llm import decontam, substrings
from tests.llm.test_minhash import brute as components
from tests.llm.test_substrings import brute as kept_words

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "bpe_encoding"]
    columns = docs.columns
    before = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for name, stage in cp.STAGES:
        after_df = stage(spark, docs, DIR).cache()
        rows = after_df.collect()
        after = {r["doc_id"]: r.asDict() for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "bpe_encoding":
            assert after_df.columns == [*columns, "ids", "n_tokens"] and set(after) == set(before)
            break
        assert after_df.columns == columns
        pairs = [(i, r["text"]) for i, r in before.items()]
        if name == "quality":
            marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
            assert all(i in after for i, q in marks.items() if q == 1)
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in components(pairs, 80).items() if i == c}
        elif name == "substring_dedup":
            want = {i: (gone, text) for i, n, gone, text in kept_words(pairs, substrings.WIDTH) if not (gone == n and n)}
            assert set(after) == set(want)
            assert all(after[i]["text"] == (text if gone else before[i]["text"]) for i, (gone, text) in want.items())
        elif name == "decontamination":
            items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            leaks = {i for i, t in pairs if any(p in decontam.normal(t) for p in items)}
            assert not leaks & set(after) and set(before) - set(after) == leaks
        before, docs = after, after_df


def test_whole_run_and_empty(spark, tmp_path):
    out = cp.run(spark, DIR)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = out.collect()
    assert out.columns == [*docs.columns, "ids", "n_tokens"] and len({r["doc_id"] for r in rows}) == len(rows) > 0
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    again = {r["doc_id"]: r["text"] for r in rows}
    assert {r["doc_id"]: r["text"] for r in cp.run(spark, DIR).collect()} == again
    empty = tmp_path / "t"
    spark.read.parquet(f"{DIR}/documents.parquet").limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(f"{DIR}/benchmark.parquet").write.parquet(str(empty / "benchmark.parquet"))
    assert cp.run(spark, str(empty)).count() == 0


def test_odd_rows_pass_through_every_stage(spark, edge_docs):
    """Null texts and ids, repeated rows, a long text and columns named like what stages add."""
    docs = edge_docs.drop("n_tokens").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.char_length("text").cast("long")})
    rows = docs.count()
    for name, stage in cp.STAGES:
        after = stage(spark, docs, DIR)
        kept = after.count()
        assert kept <= rows
        if name != "bpe_encoding":
            assert after.columns == docs.columns
            assert after.where("__id = 'z' AND unit = 'z' AND matches = 'z'").count() == kept
            assert stage(spark, docs.limit(0), DIR).count() == 0
        else:
            assert kept == rows and after.where("size(ids) <> n_tokens").count() == 0
