"""Binary media columns: bytes stored losslessly as PNG, read back, and hashed perceptually.

A payload becomes an 8-bit grey image 64 samples wide, one row filter for the
whole image, deflated and cut into chunks. Reading tests the signature, every
chunk's checksum, the header and the size of the inflated rows, and undoes row
filters with numpy; other writers' 8-bit grey, grey-alpha, RGB and RGBA images
without interlacing are read too. The feature is a perceptual hash: the image
reduced to 32 x 32 means, its cosine transform's 8 x 8 lowest frequencies, and
one bit for each that exceeds their median.

Edge cases: null data is stored as an empty payload, which is padded to 64 zero
bytes; payloads of any length are stored whole; media that is null gives a null
payload without error, and broken media a null payload and what is wrong;
repeated rows are treated alike; input columns named like an output are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.columns import without
from loomgraph.session import prepare

#: Samples of a row; payloads are padded to a multiple.
WIDTH = 64
#: Bytes of deflated data in a chunk, and zlib's level.
IDAT_BYTES = 1 << 16
LEVEL = 3

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def pad(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of the row width."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes) -> bytes:
    """A grey image of the payload, whose length must be a positive multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    # The filter with the smallest sum of absolute differences, as signed bytes.
    cost = [int(np.minimum(x, -x).sum(dtype=np.int64)) for x in (rows, sub, up)]
    best = int(np.argmin(cost))
    raw = np.empty((len(rows), WIDTH + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = best, (rows, sub, up)[best]
    packed = zlib.compress(raw.tobytes(), LEVEL)
    body = b"".join(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def unfilter(raw: np.ndarray, pixel: int) -> np.ndarray:
    """Rows of samples from rows that begin with their filter's number; ``pixel`` is the bytes of one pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    of = np.flatnonzero(kinds == 1)
    if len(of):
        left = rows[of].reshape(len(of), -1, pixel)
        rows[of] = np.cumsum(left, axis=1, dtype=np.uint8).reshape(len(of), -1)
    at = 0
    while at < len(rows):
        if kinds[at] < 2:
            at += 1
            continue
        if kinds[at] == 2:
            end = at + 1
            while end < len(rows) and kinds[end] == 2:
                end += 1
            rows[at:end] = np.cumsum(rows[max(at - 1, 0) : end], axis=0, dtype=np.uint8)[1 if at else 0 :]
            at = end
            continue
        above = rows[at - 1].astype(int) if at else np.zeros(rows.shape[1], int)
        row = rows[at].tolist()
        for x, value in enumerate(row):
            a = row[x - pixel] if x >= pixel else 0
            b = int(above[x])
            if kinds[at] == 3:
                row[x] = (value + (a + b) // 2) & 255
            else:
                c = int(above[x - pixel]) if x >= pixel else 0
                p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                row[x] = (value + (a if p <= q and p <= r else b if q <= r else c)) & 255
        rows[at] = row
        at += 1
    return rows


def read_png(media: bytes) -> tuple[np.ndarray, int]:
    """(rows of samples, channels); raises ValueError for broken or unsupported media."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, header, ended = 8, [], None, False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut short")
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media):
            raise ValueError("cut short")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind.decode('latin-1')}")
        if kind == b"IHDR" and size == 13:
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + size
    if header is None or not ended or not packed:
        raise ValueError("a chunk is missing")
    width, height, depth, colour, _, _, interlace = header
    if depth != 8 or colour not in CHANNELS or interlace or not width or not height:
        raise ValueError("unsupported kind of image")
    stride = width * CHANNELS[colour]
    opened = zlib.decompressobj()
    try:
        raw = opened.decompress(b"".join(packed), height * (stride + 1) + 1)
    except zlib.error as e:
        raise ValueError("broken deflate stream") from e
    if len(raw) != height * (stride + 1) or not opened.eof:
        raise ValueError("rows do not fill the image")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, stride + 1), CHANNELS[colour]), CHANNELS[colour]


_SIDE, _LOW = 32, 8
_COSINES = np.cos(np.pi * (2 * np.arange(_SIDE)[None, :] + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE))


def _means(x: np.ndarray, n: int) -> np.ndarray:
    """Means of n equal runs along the first axis; short axes are stretched."""
    if len(x) < n:
        return x[np.arange(n) * len(x) // n]
    bounds = np.arange(n + 1) * len(x) // n
    return np.add.reduceat(x, bounds[:-1], axis=0) / np.diff(bounds).reshape(-1, *[1] * (x.ndim - 1))


def perceptual_hash(rows: np.ndarray, channels: int = 1) -> str:
    """64 bits of the lowest frequencies, as 16 hexadecimal digits."""
    grey = rows if channels == 1 else rows.reshape(len(rows), -1, channels)[:, :, : 3 if channels > 2 else 1].mean(axis=2)
    small = _means(_means(grey.astype(np.float64), _SIDE).T, _SIDE).T
    # Whole sixteenths, so that no rounding of sums can turn a bit.
    low = np.rint(_COSINES @ small @ _COSINES.T * 16).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store(df: DataFrame, data: str, *, media: str = "media") -> DataFrame:
    """Adds a binary column with the PNG of each value (string or binary)."""
    df = without(df, [media])
    prepare(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [write_png(pad(x.as_buffer().to_pybytes() if x.is_valid else b"")) for x in batch.column(data)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(images, pa.binary())], names=[*batch.schema.names, media])

    return df.mapInArrow(run, schema)


def load(df: DataFrame, *, media: str = "media", payload: str = "payload", feature: str = "feature", error: str = "media_error") -> DataFrame:
    """Adds the samples that are read back, their perceptual hash, and what is wrong with media that can't be read."""
    df = without(df, [payload, feature, error])
    prepare(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(payload, T.BinaryType()), T.StructField(feature, T.StringType()), T.StructField(error, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, features, errors = [], [], []
            for value in batch.column(media):
                samples = hashed = wrong = None
                if value.is_valid:
                    try:
                        rows, channels = read_png(value.as_buffer().to_pybytes())
                        samples, hashed = rows.tobytes(), perceptual_hash(rows, channels)
                    except ValueError as e:
                        wrong = str(e)
                payloads.append(samples)
                features.append(hashed)
                errors.append(wrong)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, payload, feature, error])

    return df.mapInArrow(run, schema)
