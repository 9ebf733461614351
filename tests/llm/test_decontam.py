import random

from loomgraph.llm import decontam


def least_edits(pattern, text):
    """Edits of the whole pattern against its best place in the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(rnd, text, n):
    for _ in range(n):
        k = rnd.randrange(len(text))
        text = rnd.choice([text[:k] + rnd.choice("xyz") + text[k:], text[:k] + text[k + 1 :], text[:k] + rnd.choice("xyz") + text[k + 1 :]])
    return text


def run(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: {m["item_id"]: m["edits"] for m in r["matches"]} for r in decontam.contaminated(d, b, **how).collect()}


def test_against_dynamic_programming(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "in", "ea", "st"]) for _ in range(rnd.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(rnd.choice([4, 6, 20, 40]))) for k in range(12)]
    docs = []
    for i in range(60):
        k, p = rnd.choice(items)
        p = edit(rnd, p, rnd.choice([0, 0, 1, 2, 4, 8, 14]))
        docs.append((i, f"{text(rnd.randrange(0, 30))} {p.upper() if i % 5 == 0 else p}\n {text(rnd.randrange(0, 30))}"))
    got = run(spark, docs, items)
    want = {}
    for i, t in docs:
        want[i] = {}
        for k, p in items:
            p = decontam.normal(p)
            if len(p) < decontam.MIN_CHARS:
                if f" {p} " in f" {decontam.normal(t)} ":
                    want[i][k] = 0
            elif (e := least_edits(p, decontam.normal(t))) <= int(len(p) * decontam.EDIT_RATE):
                want[i][k] = e
    assert {i: set(x) for i, x in got.items()} == {i: set(x) for i, x in want.items()}
    assert got == want
    assert sum(map(len, want.values())) > 20


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    rnd = random.Random(10)
    items = [(k, " ".join(f"w{rnd.randrange(900)}" for _ in range(30))) for k in range(9)]
    long = " ".join(f"v{rnd.randrange(900)}" for _ in range(3000))
    docs = [(0, long), (1, long[:9000] + " " + items[3][1] + " " + long[9000:]), (2, items[8][1] + long), (3, long + " " + items[0][1])]
    whole = run(spark, docs, items)
    assert {i: set(x) for i, x in whole.items()} == {0: set(), 1: {3}, 2: {8}, 3: {0}}
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)
    assert run(spark, docs, items) == whole
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontam.contaminated(d, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 1
    monkeypatch.setattr(decontam, "SLICE", 7)
    indexes = [decontam.Index([(k, decontam.normal(t)) for k, t in items], 12)]
    monkeypatch.setattr(decontam, "PART", 1000)
    out = [{} for _ in docs]
    decontam._search([decontam.normal(t) for _, t in docs], indexes, out)
    assert [set(x) for x in out] == [set(whole[i]) for i in range(4)]


def test_edges(edge_docs, no_docs, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "tiny"), (4, edge_docs.where("doc_id = 5").first()["text"]), (5, edge_docs.where("doc_id = 5").first()["text"])], "item_id long, text string")
    rows = {(repr(r["doc_id"])): [m["item_id"] for m in r["matches"]] for r in decontam.contaminated(edge_docs, items).where("doc_id IS NOT NULL").collect()}
    assert {k for k, v in rows.items() if v} == {"5", "6", "7", "10"} and rows["7"] == [4, 5]
    assert decontam.contaminated(no_docs, items).count() == 0
    assert decontam.contaminated(edge_docs, items.limit(0)).where("size(matches) > 0").count() == 0


def test_short_items_stand_between_blanks(spark, monkeypatch):
    """In one piece and in parts, where an item lies across or at a cut."""
    rnd = random.Random(14)
    items = [(1, "Tiny  one"), (2, "ab"), (3, "ab"), (4, "x")]
    docs = [(i, " ".join(rnd.choice(["tiny", "one", "ab", "abx", "x.", "yy", "tinyone"]) for _ in range(rnd.randrange(0, 60)))) for i in range(80)]
    want = {i: {k: 0 for k, p in items if f" {decontam.normal(p)} " in f" {decontam.normal(t)} "} for i, t in docs}
    assert run(spark, docs, items) == want
    index = decontam.Exact([(k, decontam.normal(p)) for k, p in items])
    for part in (5, 16, 33):
        monkeypatch.setattr(decontam, "PART", part)
        out = [{} for _ in docs]
        decontam._search([decontam.normal(t) for _, t in docs], [index], out)
        assert [set(x) for x in out] == [set(want[i]) for i, _ in docs]


def test_grams_that_occur_everywhere():
    """An item and a text of one letter share every gram at every place; slices bound what is expanded."""
    index = decontam.Index([(k, "a" * (60 + k)) for k in range(20)], 12)
    out = [{}, {}]
    decontam._search(["a" * 6000, "b" * 6000], [index], out)
    assert {k: e for k, (e, _, _) in out[0].items()} == {k: 0 for k in range(20)} and out[1] == {}
