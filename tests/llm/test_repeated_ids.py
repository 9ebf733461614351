import corpus_pipeline


def test_one_row_stays_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(100))
    other, third, fourth = (" ".join(f"{c}{i}" for i in range(100)) for c in "xyz")
    rows = [(5, text), (5, text), (5, text + " end"), (7, text), (None, text), (5, other), (None, third), (None, third), (None, third + " end"), (9, other), (3, "few words"), (None, fourth)]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    starts = sorted(r["text"].split(" ")[0] for r in kept)
    assert starts == ["few", "w0", "x0", "y0", "z0"]
    assert all(r["doc_id"] is not None for r in kept if r["text"].startswith(("w0", "few")))
    assert corpus_pipeline.near_dedup_stage(spark, docs.where("doc_id IN (3, 7, 9)"), "").count() == 3
