"""Media columns: payloads stored as lossless WebP images and read back.

A payload (a text's bytes, filled up to rows of 576) becomes ARGB pixels, four
samples each, 144 to a row; rows are cut into frames of bounded size, each a
WebP file that takes a palette, references and the colour cache, or predictor
and cross-colour transforms where its pixels call for them. The stored form is
an array of files in a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import batches
from .webp import code_lengths, decode_many, encode_many

ROW, FILL = 576, 255
WIDTH = ROW // 4
FRAME_ROWS = 16


def text_code() -> np.ndarray:
    """Code lengths of all bytes by a rule, alike for all texts: blanks and small letters are common, then bytes of two-byte letters, then the rest of ASCII."""
    weights = np.ones(256, np.int64)
    weights[32:127] = 8
    weights[0x80:0xC4] = 8
    weights[[10, 44, 46, 0xC3, FILL]] = 64
    weights[ord("a") : ord("z") + 1] = 128
    weights[[ord(c) for c in "aehinorst"]] = 512
    weights[32] = 1024
    return code_lengths(weights)


def payload_of(text: bytes) -> bytes:
    return text + bytes([FILL]) * (-len(text) % ROW if text else ROW)


def frames_of(payload: bytes) -> list[np.ndarray]:
    pixels = np.frombuffer(payload, ">u4").astype(np.uint32).reshape(-1, WIDTH)
    return [pixels[i : i + FRAME_ROWS] for i in range(0, len(pixels), FRAME_ROWS)]


def feature_of(frames: list[np.ndarray]) -> str:
    """Size, mean sample, and an average hash: 64 stretches of the samples, each a bit for a mean above the whole's."""
    samples = np.concatenate([f.ravel() for f in frames]).astype(">u4").view(np.uint8).astype(np.int64)
    sums = np.add.reduceat(samples, np.arange(64) * len(samples) // 64)
    bits = sums * 64 > samples.sum()
    return f"{WIDTH}x{len(samples) // ROW}:{samples.mean():.3f}:{int(np.packbits(bits).tobytes().hex(), 16):016x}"


def _store(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = text_code()
    for batch in parts:
        for part, texts in batches(batch, "__text"):
            frames = [frames_of(payload_of(t)) for t in texts]
            files = encode_many([f for own in frames for f in own], code)
            offsets = np.cumsum([0, *(len(own) for own in frames)]).astype(np.int32)
            part = part.drop_columns(["__text"]).append_column("n_bytes", pa.array([len(t) for t in texts], pa.int64()))
            yield part.append_column("media", pa.ListArray.from_arrays(pa.array(offsets), pa.array(files, pa.binary())))


def _parts(batch: pa.RecordBatch, at: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of files in its column `at`."""
    start = size = 0
    for i in range(batch.num_rows):
        own = batch.column(at)[i]
        size += sum(len(f.as_buffer()) for f in own.values) if own.is_valid else 0
        if size > most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        at = batch.schema.get_field_index("media")
        for part in _parts(batch, at):
            stored = part.column(at).to_pylist()
            images = iter(decode_many([f for own in stored for f in own or ()]))
            payloads, features = [], []
            for own in stored:
                frames = [next(images) for _ in own or ()]
                payloads.append(b"".join(f.astype(">u4").tobytes() for f in frames))
                features.append(feature_of(frames) if frames else None)
            yield part.append_column("payload", pa.array(payloads, pa.binary())).append_column("feature", pa.array(features, pa.string()))


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def store_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_bytes (of the text in UTF-8, null: 0) and media (array of WebP files that hold its payload).

    Equal texts give equal files. Null and empty texts are a row of fill;
    repeated rows and null ids are stored row by row; columns with these names
    are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("n_bytes", "media", "__text")
    return docs.withColumn("__text", F.col(text_col)).mapInArrow(_store, f"{_fields(docs)}n_bytes long, media array<binary>")


def read_media(stored: DataFrame) -> DataFrame:
    """`stored` with payload (bytes read back from media's files) and feature; null or empty media gives no bytes and a null feature. A damaged file stops the job."""
    stored = stored.drop("payload", "feature")
    return stored.mapInArrow(_read, f"{_fields(stored)}payload binary, feature string")
