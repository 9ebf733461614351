import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import media


def png_with(rows, kinds, channels=1):
    """An independent writer: each row with the filter asked for, by the standard's definitions."""
    h, stride = rows.shape
    raw, prior = bytearray(), [0] * stride
    for row, kind in zip(rows.tolist(), kinds, strict=True):
        raw.append(kind)
        for x, v in enumerate(row):
            a = row[x - channels] if x >= channels else 0
            b, c = prior[x], prior[x - channels] if x >= channels else 0
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            raw.append((v - [0, a, b, (a + b) // 2, best][kind]) & 255)
        prior = row
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", stride // channels, h, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"k\0v") + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_all_filters_are_undone(channels):
    rnd = np.random.default_rng(channels)
    rows = rnd.integers(0, 256, (40, 12 * channels), dtype=np.uint8)
    for kinds in ([k] * 40 for k in range(5)):
        assert (media.read_png(png_with(rows, kinds, channels))[0] == rows).all()
    assert (media.read_png(png_with(rows, rnd.integers(0, 5, 40).tolist(), channels))[0] == rows).all()


def test_round_trip_and_damage():
    rnd = random.Random(7)
    for n in (0, 1, 63, 64, 65, 5000, 300_000):
        payload = media.pad(bytes(rnd.choice(b"abc \xff\x00") for _ in range(n)))
        assert len(payload) % 64 == 0 and len(payload) >= 64
        image = media.write_png(payload)
        assert media.read_png(image)[0].tobytes() == payload
    for broken in (b"", image[:100], image[:-12], b"x" + image[1:], image[:60] + bytes([image[60] ^ 1]) + image[61:], png_with(np.zeros((2, 4), np.uint8), [0, 0]).replace(b"IEND", b"IENX")):
        with pytest.raises(ValueError):
            media.read_png(broken)


def test_feature_is_the_cosine_transform():
    rows = np.random.default_rng(3).integers(0, 256, (64, 64), dtype=np.uint8)
    small = rows.reshape(32, 2, 32, 2).mean(axis=(1, 3))
    low = np.array([[sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)])
    bits = np.rint(low * 16).ravel()
    assert media.perceptual_hash(rows) == np.packbits(bits > np.median(bits[1:])).tobytes().hex()
    assert media.perceptual_hash(np.clip(rows.astype(int) + 1, 0, 255).astype(np.uint8)) != ""


def test_edges(edge_docs, no_docs, spark):
    got = media.load(media.store(edge_docs, "text")).select("doc_id", "text", "payload", "feature", "media_error").collect()
    assert len(got) == edge_docs.count()
    for r in got:
        want = media.pad((r["text"] or "").encode())
        assert hashlib.sha256(bytes(r["payload"])).digest() == hashlib.sha256(want).digest() and r["media_error"] is None and len(r["feature"]) == 16
    assert media.load(media.store(no_docs, "text")).count() == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "id long, media binary")
    rows = {r["id"]: r for r in media.load(odd).collect()}
    assert rows[1]["payload"] is None and rows[1]["media_error"] is None
    assert rows[2]["payload"] is None and rows[2]["media_error"] == "no PNG signature"
    same = media.load(media.store(edge_docs, "text")).groupBy("text").agg(F.count_distinct("feature", "payload").alias("n")).where("n > 1")
    assert same.count() == 0
