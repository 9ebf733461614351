"""The registered queries that SQL cannot express, over the whole smallest tables, against plain computation."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import decontam, packing, queries

DIR = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_op1(spark, docs, tokenizer_path):
    library = Tokenizer.from_file(tokenizer_path)
    library.no_truncation()
    library.no_padding()
    want = {}
    for i, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op1_bpe_round_trip(spark, DIR).collect()} == want


def test_op2(spark, docs):
    encoder = packing._encoder(open(queries.BYTE_RANKS, "rb").read())
    ids = {i: encoder.encode_ordinary(t) for i, t in docs.items()}
    n = packing.ROW_TOKENS
    left = {(i, k) for i, x in ids.items() for k in range(-(-len(x) // n))}
    for r in queries.op2_token_packing(spark, DIR).collect():
        pieces = [ids[d][p * n : (p + 1) * n] for d, p in zip(r["doc_ids"], r["pieces"], strict=True)]
        flat = [x for piece in pieces for x in piece]
        places = [k for piece in pieces for k in range(len(piece))]
        assert r["n_tokens"] == len(flat) and r["cu_seqlens"] == np.cumsum([0, *map(len, pieces)]).tolist()
        assert r["ids_sha256"] == sha(np.array(flat + [packing.PAD] * (n - len(flat)), "<u2").tobytes())
        assert r["positions_sha256"] == sha(np.array(places + [0] * (n - len(flat)), "<u4").tobytes())
        for key in zip(r["doc_ids"], r["pieces"], strict=True):
            left.remove(key)
    assert not left


def test_op5(spark, docs):
    rows = {r["doc_id"]: r for r in queries.op5_media_columns(spark, DIR).collect()}
    assert set(rows) == set(docs)
    same = {}
    for i, t in docs.items():
        raw = t.encode()
        payload = raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert same.setdefault(t, (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    assert len({r["media_sha256"] for r in rows.values()}) == len(same)


def best(pattern, text):
    """Least edits of the whole pattern at its best place in the text, a row of the table at a time."""
    p, t = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (pattern, text))
    row, ramp = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for k, c in enumerate(p, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def test_op7(spark, docs):
    """Every fourth item of the benchmark against every document."""
    items = [(r["item_id"], decontam.normal(r["text"])) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() if r["item_id"] % 4 == 0]
    got = queries.op7_decontamination(spark, DIR).collect()
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        text = decontam.normal(docs[r["doc_id"]])
        want = sorted(i for i, p in items if best(p, text) <= int(len(p) * decontam.EDIT_RATE))
        assert [i for i in r["item_ids"] if i % 4 == 0] == want
        assert r["contaminated"] == bool(r["item_ids"])


def test_op3_and_op8_have_a_row_for_each_document(spark, docs):
    quality = queries.op3_quality(spark, DIR).collect()
    assert {r["doc_id"] for r in quality} == set(docs) and len(quality) == len(docs)
    toxic = queries.op8_toxicity(spark, DIR).collect()
    assert {r["doc_id"] for r in toxic} == set(docs)
    for r in toxic:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
