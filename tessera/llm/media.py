"""Media columns: bytes kept without loss in progressive JPEG files, read back, and turned into RGB tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import jpeg
from tessera.llm.common import chunks, in_batches

#: Bytes of payload that are coded together; a longer payload is coded alone, whole.
BATCH = 1 << 20


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of 64, the coefficients of a block."""
    return data + bytes(64 if not data else -len(data) % 64)


def described(rgb: np.ndarray) -> str:
    """Size, channel means and spread, from whole-number sums, so equal pictures give equal strings."""
    h, w, _ = rgb.shape
    flat = rgb.reshape(-1, 3).astype(np.int64)
    total, square = flat.sum(axis=0), (flat**2).sum(axis=0)
    n = h * w
    spread = np.maximum(n * square - total**2, 0) ** 0.5 / n
    return f"{w}x{h};" + ",".join(f"{t / n:.3f}" for t in total) + ";" + ",".join(f"{x:.3f}" for x in spread)


def stored_as_jpeg(df: DataFrame, data: str, tensors: bool = True) -> DataFrame:
    """df with media, payload, width, height, feature and, if asked for, rgb (height x width x 3 bytes) of a text or binary column.

    Each byte of the padded data is one coefficient, as a signed number, which Huffman coding keeps without loss; media
    is the file, payload what is read back from it. The tensor is the picture that any reader would see: inverse
    transform, chroma at full resolution, RGB. Null and empty data are one block of zeros. The data column is dropped,
    other columns are kept, but for those named like the results. Rows are independent of each other.
    """
    new = [("media", "binary"), ("payload", "binary"), ("width", "int"), ("height", "int"), ("feature", "string")] + [("rgb", "binary")] * tensors
    names = {name for name, _ in new} | {"rgb", data}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{name} {kind}" for name, kind in new])
    plain = df.select(*[f"`{f.name}`" for f in kept], F.col(f"`{data}`").cast("binary").alias(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, data, BATCH):
                payloads = [padded(x or b"") for x in part.column(data).to_pylist()]
                files = jpeg.encode([np.frombuffer(x, np.int8).reshape(-1, 64) for x in payloads])
                frames, coefficients = jpeg.decode(files)
                back, features, pictures = [], [], []
                for frame, x in zip(frames, payloads, strict=True):
                    back.append(coefficients[frame.base : frame.base + len(x) // 64].astype(np.int8).tobytes())
                    rgb = jpeg.samples(frame, coefficients)
                    features.append(described(rgb))
                    if tensors:
                        pictures.append(rgb.astype(np.uint8, copy=False).tobytes())
                columns = [pa.array(files, pa.binary()), pa.array(back, pa.binary()), pa.array([f.width for f in frames], pa.int32()), pa.array([f.height for f in frames], pa.int32()), pa.array(features, pa.string())]
                if tensors:
                    columns.append(pa.array(pictures, pa.binary()))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *columns], names=[*[f.name for f in kept], *[name for name, _ in new]])

    return in_batches(plain, run, schema)


def media_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height, rgb_sha256.

    One row for every row, repeated ones with equal values; an empty table gives none, a null text counts as empty, a very
    long one is coded alone and whole, and columns other than doc_id and text play no part. rgb_sha256 is of the tensor
    column, height x width x 3 bytes.
    """
    slim = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = stored_as_jpeg(slim, "text")
    size = F.octet_length("payload")
    return out.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), size - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "width",
        "height",
        F.sha2("rgb", 256).alias("rgb_sha256"),
    )
