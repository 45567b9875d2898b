"""Media columns: payloads stored as progressive JPEG files, read back as RGB tensors.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, fill the
coefficients of a frame with 2 x 2 subsampled chroma. The file is the stored
form; decoding accumulates its scans into coefficient arrays, from which the
payload comes back byte for byte and the full-resolution RGB tensor is made.

Defined cases: a null or empty text has a payload of 64 zero bytes; null or
repeated doc_ids and equal rows are kept as they are; other columns are
ignored; an empty table gives an empty result. Memory of a task is bounded by
its slices of some MB, or by one text if that is longer.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import progressive as jpeg
from .kernels import flat, slices
from .shared import raw, table

GROUP_BYTES = 1 << 20
STORED = "doc_id {kind}, n_bytes long, payload_bytes long, media binary"
LOADED = "doc_id {kind}, payload binary, height int, width int, rgb binary"
DIGESTS = "doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _groups(frames: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Row numbers of equal frames, in runs of about GROUP_BYTES."""
    order = np.lexsort((frames[:, 0], frames[:, 1]))
    cuts = np.flatnonzero((np.diff(frames[order], axis=0) != 0).any(axis=1)) + 1
    for rows in np.split(order, cuts):
        step = max(1, GROUP_BYTES // int(64 * blocks[rows[0]]))
        for at in range(0, len(rows), step):
            yield rows[at : at + step], int(frames[rows[0], 0]), int(frames[rows[0], 1])


def encode_texts(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Files, text lengths and payload lengths of a binary column."""
    data, offsets = flat(column)
    lengths = np.diff(offsets)
    blocks = np.maximum(1, -(-lengths // 64))
    frames = np.array([jpeg.frame_of(b) for b in blocks.tolist()]).reshape(-1, 2)
    files: list[bytes] = [b""] * len(lengths)
    for rows, cols, high in _groups(frames, 6 * frames[:, 0] * frames[:, 1]):
        payloads = np.zeros((len(rows), 384 * cols * high), np.uint8)
        for k, r in enumerate(rows.tolist()):
            payloads[k, : lengths[r]] = data[offsets[r] : offsets[r + 1]]
        for r, file in zip(rows.tolist(), jpeg.encode_group(payloads, 64 * blocks[rows], cols, high), strict=True):
            files[r] = file
    return files, lengths, 64 * blocks


def decode_files(files: list[bytes], want_rgb: bool = True) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray | None]]:
    """Row numbers, payloads and RGB tensors of stored files, frame by frame."""
    frames = np.array([jpeg.frame_in(f) for f in files]).reshape(-1, 2)
    for rows, cols, high in _groups(frames, 6 * frames[:, 0] * frames[:, 1]):
        coefficients, known = jpeg.decode_group([files[r] for r in rows.tolist()], cols, high)
        payloads = jpeg.payload_of(coefficients)
        found = [payloads[k, :n].tobytes() for k, n in enumerate(known.tolist())]
        yield rows, found, jpeg.group_rgb(coefficients, cols, high) if want_rgb else None


def _feature(rgb: np.ndarray) -> list[str]:
    """Size, and mean and standard deviation by colour, from exact integer sums."""
    n, height, width, _ = rgb.shape
    flat_rgb = rgb.reshape(n, -1, 3)
    sums = flat_rgb.sum(axis=1, dtype=np.int64)
    squares = np.stack([np.einsum("ij,ij->i", c, c) for c in (flat_rgb[:, :, k].astype(np.float64) for k in range(3))], axis=1)
    count = height * width
    mean = sums / count
    spread = np.sqrt(np.maximum(0, squares / count - mean * mean))
    return [f"{width}x{height};" + ";".join(f"{a:.4f},{b:.4f}" for a, b in zip(m, s, strict=True)) for m, s in zip(mean.tolist(), spread.tolist(), strict=True)]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=1 << 23):
            files, lengths, padded = encode_texts(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths), pa.array(padded), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "media", most=1 << 22):
            ids = part.column("doc_id")
            for rows, payloads, rgb in decode_files(part.column("media").to_pylist()):
                shape = rgb.shape
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(payloads, pa.binary()), pa.array(np.full(len(rows), shape[1], np.int32)), pa.array(np.full(len(rows), shape[2], np.int32)), pa.array([x.tobytes() for x in rgb], pa.binary())],
                    ["doc_id", "payload", "height", "width", "rgb"],
                )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=1 << 23):
            files, lengths, _ = encode_texts(part.column("text"))
            n = len(files)
            size, sha, tail, feature = [0] * n, [""] * n, [0] * n, [""] * n
            for rows, payloads, rgb in decode_files(files):
                for r, payload, text in zip(rows.tolist(), payloads, _feature(rgb), strict=True):
                    size[r], sha[r], tail[r], feature[r] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), text
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(lengths), pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array(feature)],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    return docs.select("doc_id", raw("text").alias("text")), docs.schema["doc_id"].dataType.simpleString()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and the file of every text."""
    texts, kind = _texts(docs)
    return texts.mapInArrow(_store, STORED.format(kind=kind))


def load(stored: DataFrame) -> DataFrame:
    """doc_id, payload and the RGB tensor (height x width x 3 bytes) of every stored file."""
    return stored.select("doc_id", F.col("media")).mapInArrow(_load, LOADED.format(kind=stored.schema["doc_id"].dataType.simpleString()))


def digests(docs: DataFrame) -> DataFrame:
    """Store, read back and describe every text in one pass; the tensors are not kept."""
    texts, kind = _texts(docs)
    return texts.mapInArrow(_digest, DIGESTS.format(kind=kind))


def op10_media(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
