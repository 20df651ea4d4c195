"""Media columns: texts as PNG images in a binary column, read back with checksum tests, and perceptual hashes of them.

The PNG format is written and read here with zlib and numpy alone. The hash is the sign pattern of the low frequencies of a
two-dimensional cosine transform of the image, in a binary column of eight bytes.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import BLOCK_BYTES, as_bytes, blocks, column, texts_of

#: Fixed value: the first eight bytes of every PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row; payloads are padded with spaces to a positive multiple.
WIDTH = 192
#: Fixed value: channels by the PNG colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 3) -> bytes:
    """An 8-bit image, height x width or height x width x channels; each row takes the filter with the smallest sum of magnitudes."""
    samples = np.ascontiguousarray(samples, np.uint8)
    channels = samples.shape[2] if samples.ndim == 3 else 1
    colour = {v: k for k, v in CHANNELS.items()}[channels]
    height, width = samples.shape[:2]
    rows = samples.reshape(height, width * channels)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, channels:], above[1:] = rows[:, :-channels], rows[:-1]
    tried = np.stack([rows, rows - left, rows - above])
    cost = np.minimum(tried, -tried).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    body = np.empty((height, rows.shape[1] + 1), np.uint8)
    body[:, 0], body[:, 1:] = best, tried[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(row: np.ndarray, above: np.ndarray, step: int) -> None:
    for x in range(len(row)):
        a, b, c = int(row[x - step]) if x >= step else 0, int(above[x]), int(above[x - step]) if x >= step else 0
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        row[x] = (int(row[x]) + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit, non-interlaced PNG; a ValueError for what isn't one, is cut short or fails a checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise ValueError("a chunk is cut short")
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"chunk {kind!r} isn't known")
        at += 12 + size
    if head is None or not ended:
        raise ValueError("header or end is missing")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in CHANNELS or interlaced or not width or not height:
        raise ValueError("only 8-bit images without palette or interlacing")
    step = CHANNELS[colour]
    line = width * step
    opened = zlib.decompressobj()
    flat = opened.decompress(b"".join(packed), height * (line + 1) + 1)  # bounded by what the header promises
    if len(flat) != height * (line + 1) or opened.unconsumed_tail:
        raise ValueError("the image data has another size than its header")
    rows = np.frombuffer(flat, np.uint8).reshape(height, line + 1)
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max() > 4:
        raise ValueError("an unknown filter")
    sub = kinds == 1
    if sub.any():  # needs nothing of other rows
        out[sub] = np.cumsum(out[sub].reshape(-1, width, step), axis=1, dtype=np.uint8).reshape(-1, line)
    if kinds.all() and (kinds == 2).all():
        out = np.cumsum(out, axis=0, dtype=np.uint8)
    else:
        none = np.zeros(line, np.uint8)
        for y in np.flatnonzero(kinds > 1).tolist():
            above = out[y - 1] if y else none
            if kinds[y] == 2:
                out[y] += above
            elif kinds[y] == 3:
                for x in range(line):
                    out[y, x] = (int(out[y, x]) + ((int(out[y, x - step]) if x >= step else 0) + int(above[x])) // 2) & 255
            else:
                _paeth(out[y], above, step)
    return out.reshape(height, width, step) if step > 1 else out


@lru_cache(8)
def _cosines(n: int, low: int) -> np.ndarray:
    """The first ``low`` rows of the orthonormal cosine transform of ``n`` points."""
    k, x = np.mgrid[0:low, 0:n]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(np.where(k == 0, 1, 2) / n)


def _shrunk(image: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Means over ``n`` equal stretches of an axis, which may cut through samples."""
    size = image.shape[axis]
    total = np.insert(np.cumsum(image, axis=axis), 0, 0, axis=axis)
    edge = np.arange(n + 1) * size / n
    low = np.minimum(edge.astype(np.int64), size - 1)
    part = (edge - low).reshape([-1 if a == axis else 1 for a in range(image.ndim)])
    at = np.take(total, low, axis) + part * np.take(image, low, axis)
    return np.diff(at, axis=axis) * n / size


def cosine_hash(image: np.ndarray, side: int = 32, low: int = 8) -> bytes:
    """low x low bits: whether each low frequency of the image, shrunk to side x side, is above their median."""
    grey = image.astype(np.float64)
    grey = grey.mean(axis=2) if grey.ndim == 3 else grey
    small = _shrunk(_shrunk(grey, side, 0), side, 1)
    table = _cosines(side, low)
    waves = (table @ small @ table.T).ravel()
    return np.packbits(waves > np.median(waves[1:])).tobytes()


def payload(raw: bytes, width: int = WIDTH) -> bytes:
    return raw.ljust(max(width, -(-len(raw) // width) * width), b" ")


def store(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, media (PNG, binary) of every whole text; a null text counts as empty and gives one row of spaces.

    Equal texts give equal files. Null ids and repeated rows pass row by row; an empty table gives no rows.
    """

    def work(batches):
        for batch in blocks(batches):
            raw = as_bytes(batch.column("text"))
            media = [encode_png(np.frombuffer(payload(b, width), np.uint8).reshape(-1, width)) for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts_of(docs).mapInArrow(work, f"{column('doc_id', docs)}, n_bytes bigint, media binary")


def features(stored: DataFrame) -> DataFrame:
    """``stored`` with payload (the samples read back), hash (binary, 8 bytes) and error, null unless the file can't be read.

    An unreadable or null file gives null payload and hash, and the reason. Equal files give equal values; other columns pass through. What is passed on
    at once is bounded by the payloads, which may be far larger than the files.
    """

    def work(batches):
        for batch in blocks(batches, "media"):
            start, size, back, marks, errors = 0, 0, [], [], []

            def made(start, batch=batch):
                part = batch.slice(start, len(back))
                return pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.binary()), pa.array(marks, pa.binary()), pa.array(errors, pa.string())], names=[*batch.schema.names, "payload", "hash", "error"])

            for data in batch.column("media").to_pylist():
                try:
                    image = decode_png(data or b"")
                    back.append(image.tobytes())
                    marks.append(cosine_hash(image))
                    errors.append(None)
                    size += len(back[-1])
                except (ValueError, zlib.error, struct.error) as e:
                    back.append(None)
                    marks.append(None)
                    errors.append(str(e))
                if size >= BLOCK_BYTES:
                    yield made(start)
                    start, size = start + len(back), 0
                    back, marks, errors = [], [], []
            if back:
                yield made(start)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(work, f"{fields}, payload binary, hash binary, error string")


def digest(made: DataFrame) -> DataFrame:
    """What op6 reports of rows of features()."""
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", F.octet_length("payload") - 15, F.lit(16))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )


