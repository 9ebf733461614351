import numpy as np
import tiktoken

from loomgraph.llm import packing, queries


def naive(sizes, capacity):
    """Best fit over all bins, longest first; the fill of each bin."""
    room, out = [], []
    for p in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [b for b in range(len(room)) if room[b] >= sizes[p]]
        if fits:
            b = min(fits, key=lambda k: room[k])
        else:
            room.append(capacity)
            out.append([])
            b = len(room) - 1
        room[b] -= sizes[p]
        out[b].append(p)
    return out


def test_best_fit_decreasing_against_search():
    rnd = np.random.default_rng(5)
    for capacity in (1, 7, 16, 100):
        for _ in range(30):
            sizes = rnd.integers(1, capacity + 1, rnd.integers(0, 80))
            got = packing.best_fit_decreasing(sizes, capacity)
            assert sorted(p for b in got for p in b) == list(range(len(sizes)))
            assert sorted(sum(sizes[p] for p in b) for b in got) == sorted(sum(sizes[p] for p in b) for b in naive(sizes.tolist(), capacity))


def unpacked(rows, row_tokens):
    pieces = {}
    ids, positions = packing.matrices(rows, row_tokens)
    for k, r in enumerate(rows):
        cuts = r["cu_seqlens"]
        assert cuts[0] == 0 and cuts[-1] == r["n_tokens"] <= row_tokens and len(cuts) == len(r["doc_ids"]) + 1
        assert (ids[k, r["n_tokens"] :] == packing.PAD).all() and (positions[k, r["n_tokens"] :] == 0).all()
        for d, p, a, b in zip(r["doc_ids"], r["pieces"], cuts[:-1], cuts[1:], strict=True):
            assert positions[k, a:b].tolist() == list(range(b - a))
            pieces.setdefault((d, p), []).append(ids[k, a:b].tolist())
    return pieces


def test_nothing_is_lost(spark, edge_docs, no_docs):
    encoder = packing._encoder(open(queries.BYTE_RANKS, "rb").read())
    assert isinstance(encoder, tiktoken.Encoding)
    unique = edge_docs.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    for row_tokens, group in ((64, 1000), (2048, 4_000_000)):
        rows = packing.pack(unique, queries.BYTE_RANKS, row_tokens=row_tokens, group_tokens=group).collect()
        pieces = unpacked(rows, row_tokens)
        for r in unique.collect():
            want = encoder.encode_ordinary(r["text"] or "")
            mine = [x for k in sorted(k for k in pieces if k[0] == r["doc_id"]) for x in pieces[k][0]]
            assert mine == want
        assert all(len(v) == 1 for v in pieces.values())
    assert len({(r["shard"], r["bin"]) for r in rows}) == len(rows)
    assert packing.pack(no_docs, queries.BYTE_RANKS).count() == 0
    total = sum(len(encoder.encode_ordinary(r["text"] or "")) for r in edge_docs.collect())
    assert sum(r["n_tokens"] for r in packing.pack(edge_docs, queries.BYTE_RANKS).collect()) == total


def test_long_white_space(spark, monkeypatch):
    encoder = packing._encoder(open(queries.BYTE_RANKS, "rb").read())
    long = [" " * 2_000_000, "a" + "\n" * 1_500_000 + "b c", "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    pieces = {}
    for r in packing.pack(df, queries.BYTE_RANKS).collect():
        for d, a, b in zip(r["doc_ids"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            pieces[d] = pieces.get(d, 0) + b - a
    assert pieces == {i: len(packing.encode_whole(encoder, t)) for i, t in enumerate(long)}
    assert encoder.decode(packing.encode_whole(encoder, long[1])) == long[1]
    # Short runs are cut by the pattern itself, so a low limit must change nothing.
    monkeypatch.setattr(packing, "LONG_BLANKS", 4)
    monkeypatch.setattr(packing, "_BLANKS", packing.regex.compile(r"\p{White_Space}{4,}"))
    for text in ("  a    b", "    ", "a    ", "x \n\n\n\n y", "\t\t\t\t\tz", "p\u00a0\u00a0\u00a0\u00a0q", "    .!"):
        assert packing.encode_whole(encoder, text) == encoder.encode_ordinary(text)
