import random

import pytest

from loomgraph.llm import queries

#: Names that the operators add or use inside; inputs that have them must not break anything.
CLASHING = ["ids", "n_tokens", "decoded", "unit", "bucket", "removed", "kept", "n_words", "matches", "media", "payload", "score", "component_id", "row", "__id"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, blanks, a very long text, repeated rows, ties, and clashing columns."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long, shared = text(60_000), text(70)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "Two words"), (5, shared), (6, shared), (7, shared.upper()), (8, long), (9, long + " end"), (10, "x " + shared + " y"), (10, "x " + shared + " y"), (None, shared), (None, None), (11, "é" * 3000), (12, "a" * 200_000), (13, "naïve ß 漢字 🙂 " * 20)]
    columns = ["doc_id long", "text string", *[f"`{c}` string" for c in CLASHING]]
    return spark.createDataFrame([(i, t, *["z"] * len(CLASHING)) for i, t in rows], ", ".join(columns))


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def tokenizer_path():
    return queries.BYTE_BPE
