"""Texts as lossless 8-bit PNG in binary columns: zlib chunks with checksums, array unfiltering, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of one IDAT chunk at most, zlib level, side of the reduced image, side of the low-frequency square.
CHUNK, LEVEL, SIDE, LOW = 1 << 20, 1, 32, 8


def payload_of(data: bytes) -> bytes:
    """data and zero bytes up to the next multiple of WIDTH, at least WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, filter_type: int | None = None) -> bytes:
    """A grey 8-bit PNG, WIDTH samples a row, whose samples are payload, row by row. filter_type None: 0 (none) or 2 (up), whichever packs the whole image shorter.

    A PNG has 2 ** 31 - 1 rows at most, so 128 GiB of payload; a row of a table holds less.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    body = min((zlib.compress(_filtered(image, k), LEVEL) for k in ((0, 2) if filter_type is None else (filter_type,))), key=len)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    return b"".join(parts + [_chunk(b"IEND", b"")])


def _filtered(image: np.ndarray, kind: int) -> bytes:
    """Rows of an image, each after its filter type."""
    lines = np.empty((len(image), image.shape[1] + 1), np.uint8)
    lines[:, 0] = kind
    padded = np.zeros((len(image) + 1, image.shape[1] + 1), np.uint8)
    padded[1:, 1:] = image
    left, up, corner = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    if kind == 0:
        guess = np.uint8(0)
    elif kind < 3:
        guess = left if kind == 1 else up
    else:
        guess = _guess(np.full(1, kind), left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)
    np.subtract(image, guess, out=lines[:, 1:])
    return lines.tobytes()


def _guess(kind: np.ndarray, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What the filter of each sample predicts."""
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    return np.choose(kind, [np.zeros_like(left), left, up, (left + up) >> 1, paeth])


def read_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG without interlacing; ValueError if a checksum, a size or a chunk is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        (n,) = struct.unpack_from(">I", data, at)
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(chunk) < n or len(data) < at + 12 + n or zlib.crc32(kind + chunk) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole grey 8-bit image")
    width, height = head[:2]
    raw = zlib.decompress(b"".join(body))
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered rows, each with its filter type first. Runs of rows with none, sub or up are done as a whole, others diagonal by diagonal."""
    kind, out = lines[:, 0], lines[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise ValueError("unknown filter")
    group = np.where(kind > 2, 3, kind)
    edge = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(kind)]):
        if a == b or kind[a] == 0:
            continue
        if group[a] == 1:
            np.add.accumulate(out[a:b], axis=1, out=out[a:b])
        elif group[a] == 2:
            if a:
                out[a] += out[a - 1]
            np.add.accumulate(out[a:b], axis=0, out=out[a:b])
        else:
            _along_diagonals(out, kind.astype(np.int64), a, b)
    return out


def _along_diagonals(out: np.ndarray, kind: np.ndarray, a: int, b: int) -> None:
    """Unfilters rows a:b in place. A sample needs those left of it, above and above left: all on earlier diagonals, so a diagonal is done at once."""
    width = out.shape[1]
    whole = np.zeros((b - a + 1, width + 1), np.int16)
    whole[1:, 1:] = out[a:b]
    if a:
        whole[0, 1:] = out[a - 1]
    for d in range(b - a + width - 1):
        y = np.arange(max(0, d - width + 1), min(b - a, d + 1))
        x = d - y
        guess = _guess(kind[a + y], whole[y + 1, x], whole[y, x + 1], whole[y, x])
        whole[y + 1, x + 1] = (whole[y + 1, x + 1] + guess) & 255
    out[a:b] = whole[1:, 1:]


_COS = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: of the LOW x LOW lowest frequencies of the image reduced to SIDE x SIDE, which are above their median (the first, the mean, aside)."""
    h, w = image.shape
    rows = np.floor(np.arange(SIDE) * h / SIDE).astype(np.int64)
    cols = np.floor(np.arange(SIDE) * w / SIDE).astype(np.int64)
    sums = np.add.reduceat(np.add.reduceat(image, rows, axis=0, dtype=np.int64), cols, axis=1)
    area = np.maximum(np.diff(np.append(rows, h)), 1)[:, None] * np.maximum(np.diff(np.append(cols, w)), 1)[None, :]
    low = _COS @ (sums / area) @ _COS.T
    flat = np.round(low.ravel(), 6)
    bits = flat > np.median(flat[1:])
    return np.packbits(bits).tobytes().hex()


def stored(text: Column) -> Column:
    """The PNG of a text's UTF-8 bytes; null counts as empty."""

    def png(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: write_png(payload_of((t or "").encode("utf-8", "surrogatepass"))))

    return F.pandas_udf(png, "binary", F.PandasUDFType.SCALAR_ITER)(text)


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: Column) -> Column:
    """What a stored PNG holds, read back: struct of payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), media_bytes, media_sha256, feature."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for m in s:
                image = read_png(m)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(image)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FEATURES.split(", ")])

    return F.pandas_udf(read, _FEATURES, F.PandasUDFType.SCALAR_ITER)(media)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8) and media (the PNG, binary) of docs (doc_id, text)."""
    return in_batches(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), stored(F.col("text")).alias("media"))


def media_features(media: DataFrame) -> DataFrame:
    """One row per row of a media table: doc_id, n_bytes, and what the stored image holds.

    Null and empty texts are one row of 64 zero bytes. Equal texts give equal values; repeated rows are rows of their own; an
    empty table gives an empty result. A damaged image is an error.
    """
    return media.select("doc_id", "n_bytes", features(F.col("media")).alias("f")).select("doc_id", "n_bytes", "f.*")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(media_table(documents(spark, sf_dir)))
