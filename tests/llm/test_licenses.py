import random
import re

from loomgraph.llm import licenses


def brute(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def scan(df):
    return licenses.scan_licenses(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()


def test_base_places_against_brute_force(spark):
    rnd = random.Random(6)
    parts = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC", "cc-by/nc 4", "under the", "mit", "éK x", "apache license version two", "word", "!!", "ǅ", "The End."]
    rows = [(i, rnd.choice([" ", ", ", "\n", "\x00"]).join(rnd.choice(parts) for _ in range(rnd.randrange(0, 14)))) for i in range(300)]
    for r in scan(spark.createDataFrame(rows, "doc_id long, text string")):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(rows[r["doc_id"]][1])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_notices_with_edits_are_found(spark):
    notice = licenses.NOTICES[0][0].split()
    edited = notice[:6] + ["hereby", "also"] + notice[6:14] + notice[15:]
    rows = [(0, "x " * 20 + " ".join(notice)), (1, " ".join(edited) + " y"), (2, " ".join(notice[:5])), (3, "plain text that has no notice"), (4, "GNU General Public License, version 3. All rights reserved.")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[0] == ("mit", 1.0)
    assert got[1][0] == "mit" and 0.6 <= got[1][1] < 1
    assert got[2] == ("", 0.0) and got[3] == ("", 0.0)
    assert got[4] == ("all-rights-reserved,gpl", 1.0)
    spans = {(r["doc_id"], r["first"], r["end"]) for r in licenses.license_spans(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()}
    assert spans == {(0, 20, 20 + len(notice))}


def test_main_path_is_native(spark):
    plan = licenses.scan_licenses(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("ArrowEval", "Python"))


def test_edges(edge_docs, no_docs):
    rows = scan(edge_docs)
    assert len(rows) == edge_docs.count()
    want = sorted((repr(r["doc_id"]), brute(r["text"])[0]) for r in edge_docs.collect())
    assert sorted((repr(r["doc_id"]), r["n_words"]) for r in rows) == want
    assert scan(no_docs) == []


def test_whole_texts_with_edits_and_punctuation(spark):
    """Each public text with a holder put in, a word in 25 changed and marks between words, in a longer text."""
    rnd, rows, want = random.Random(8), [], []
    for words, label in licenses.NOTICES:
        ws = words.split()
        if len(ws) < 40:
            continue
        for i in range(12, len(ws), 25):
            ws[i] = "qq"
        ws[20:20] = ["Example", "Holder"]
        marked = [w.title() + rnd.choice([",", ".", "\n", " -", ""]) for w in ws]
        rows.append((len(rows), "Before it. " * 30 + " ".join(marked) + " and after"))
        want.append(label)
    got = {r["doc_id"]: r["labels"].split(",") for r in scan(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert len(rows) > 10
    assert all(label in got[i] for i, label in enumerate(want))


def test_given_templates(spark):
    table = spark.createDataFrame([("own", "1", "You may use this, but never on a Monday.", False), ("none", "", None, False), ("short", "", "a b", True)], "label string, version string, text string, base boolean")
    rows = [(0, "x you may use this but never on a monday y"), (1, "under the mit license"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs, templates=table).collect()}
    assert got == {0: "own", 1: "", 2: ""}
