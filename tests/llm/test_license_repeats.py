import random

from loomgraph.llm import licenses


def test_short_notices_in_a_row_are_found(spark):
    short = [(p, label) for p, label in licenses.NOTICES if len(p.split()) <= licenses.SHORT]
    long = [(p, label) for p, label in licenses.NOTICES if len(p.split()) > licenses.SHORT]
    rnd = random.Random(9)
    rows, want = [], []
    for phrase, label in short + long[:3]:
        words = phrase.split()
        for times in (1, 2, 3, 7):
            for gap in (0, 1, 3):
                noise = [rnd.choice(words) for _ in range(gap)]
                rows.append((len(rows), " ".join([*words, *noise] * times)))
                want.append(label)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, text in rows:
        assert want[n] in got[n]["labels"].split(",") and got[n]["score"] == 1.0, text


def test_copies_in_a_row_are_spans_of_their_own(spark):
    df = spark.createDataFrame([(0, "all rights reserved " * 3)], "doc_id long, text string")
    assert sorted((r["first"], r["end"]) for r in licenses.license_spans(df).collect()) == [(0, 3), (3, 6), (6, 9)]
