"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's features are the damped, idf-weighted shares of its hashed byte n-grams, how far those concentrate on few
of them, and its size; a truncated singular value
decomposition of a bounded labelled sample gives the latent space. The sample's vectors are broadcast, and every
document is compared with all of them, in blocks of exact cosine products; its neighbours' labels count by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, crc_mod, flat_bytes, in_batches
from tessera.llm.grams import byte_grams
from tessera.llm.learning import fitted, in_fold, joined_sample

ORDERS = (1, 2, 3)
BUCKETS = 1 << 11
REPEATS = (4, 8)
WIDTH = len(ORDERS) * BUCKETS + len(REPEATS) + 1
SHAPE = 0.6


def counts(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """texts x WIDTH: for each order the square roots of the shares of its hashed n-grams; then the shape of the text.

    The shape is how often n-grams of each order in REPEATS recur, as the log of the sum of their squared shares
    relative to a text of distinct ones, and the log of the size.
    """
    n = len(at) - 1
    out = np.zeros((n, WIDTH), np.float32)
    for k, order in enumerate(ORDERS):
        bucket, owner = byte_grams(flat, at, order, BUCKETS)
        part = np.bincount(owner.astype(np.int64) * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, k * BUCKETS : (k + 1) * BUCKETS] = np.sqrt(part / np.maximum(part.sum(axis=1, keepdims=True), 1))
    for k, order in enumerate(REPEATS):
        bucket, owner = byte_grams(flat, at, order, BUCKETS)
        part = np.bincount(owner.astype(np.int64) * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
        total = np.maximum(part.sum(axis=1), 1)
        out[:, len(ORDERS) * BUCKETS + k] = SHAPE * np.log(1 + (part**2).sum(axis=1) / total**2 * np.minimum(total, BUCKETS))
    out[:, -1] = SHAPE / 4 * np.log1p(np.diff(at))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class NeighbourModel:
    project: np.ndarray  # features x dim, with the features' weights
    centre: np.ndarray
    vectors: np.ndarray  # labelled rows x dim, of unit length
    labels: np.ndarray  # of those rows, 0 or 1
    neighbours: int

    def latent(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        return unit((counts(flat, at) - self.centre) @ self.project).astype(np.float32)

    def score(self, flat: np.ndarray, at: np.ndarray, block: int = 256) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(at) - 1, 0.5)
        x = self.latent(flat, at)
        out = np.zeros(len(x))
        k = min(self.neighbours, len(self.labels))
        for start in range(0, len(x), block):
            near = x[start : start + block] @ self.vectors.T
            best = np.argpartition(near, -k, axis=1)[:, -k:]
            closeness = np.maximum(np.take_along_axis(near, best, 1), 1e-6) ** 4
            out[start : start + block] = np.clip((closeness * self.labels[best]).sum(axis=1, dtype=np.float64) / closeness.sum(axis=1, dtype=np.float64), 0, 1)
        return out


def fit(sample: pa.Table, dim: int = 48, neighbours: int = 15, seed: int = 11) -> NeighbourModel:
    """sample: text and label. The decomposition is by a randomised range finder, in numpy."""
    y = np.array([float(x) for x in sample.column("label").to_pylist()])
    width = WIDTH
    if not len(y):
        return NeighbourModel(np.zeros((width, 1), np.float32), np.zeros(width, np.float32), np.zeros((0, 1), np.float32), y, neighbours)
    text = sample.column("text").combine_chunks()
    x = np.concatenate([counts(*flat_bytes(text.slice(i, 256))) for i in range(0, len(y), 256)])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    idf[len(ORDERS) * BUCKETS :] = 1
    centre = x.mean(axis=0)
    x = (x - centre) * idf
    rng = np.random.default_rng(seed)
    dim = min(dim, len(y), width)
    q = np.linalg.qr(x @ rng.normal(size=(width, dim + 8)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    right = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dim]
    return NeighbourModel((idf[:, None] * right.T).astype(np.float32), centre, unit(x @ right.T).astype(np.float32), y, neighbours)


def score(df: DataFrame, model: NeighbourModel, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of its text column (0 to 1); null texts are scored as empty ones. Rows keep their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the features
    kept = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in range(0, batch.num_rows, 256):
                for part in chunks(batch.slice(rows, 256), text, 1 << 20):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(*flat_bytes(part.column(text))), pa.float64())], names=[*part.schema.names, out])

    return in_batches(df.select(*[f"`{f.name}`" for f in kept]), run, schema)


def trained(documents: DataFrame, labels: DataFrame, most: int = 2000) -> NeighbourModel:
    """The model of labels.quality, from about ``most`` rows of each label outside the held-out fold."""
    return fitted(joined_sample(documents, labels.where(~in_fold(crc_mod("doc_id", 5), 0)), "quality", most), fit)


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; nulls, empty texts and repeated rows have their scores too."""
    model = trained(documents, labels)
    fold = in_fold(crc_mod("doc_id", 5), 0)
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
