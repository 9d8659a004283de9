"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

N-grams are of code points of the case-folded text. Which of them a text holds, and not how often, makes its features. Each feature is scaled by the log of the ratio of
its smoothed shares among toxic and clean texts; logistic regression over the scaled features is trained by
gradient descent in numpy. Scale and weight fold into one table, so a score is a sum over the n-grams of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, crc_mod, in_batches
from tessera.llm.grams import character_grams, code_points
from tessera.llm.learning import fitted, in_fold, joined_sample

ORDERS = (4, 5, 6)
BUCKETS = 1 << 20
#: N-grams that are hashed at once.
BLOCK = 1 << 18


@dataclass(frozen=True)
class NaiveBayesLinear:
    """table: the weight of each bucket, of which most are 0; bias."""

    table: np.ndarray
    bias: float

    def score(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        held = presence(flat, at, self.table != 0)
        n = len(at) - 1
        z = self.bias + np.bincount(held // BUCKETS, weights=self.table[held % BUCKETS], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def presence(flat: np.ndarray, at: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """text * BUCKETS + bucket of every n-gram (of the buckets where among holds) that a text has, once each, in order.

    N-grams are hashed BLOCK at a time, so a very long text takes no more memory for them than a short one.
    """
    parts = [np.zeros(0, np.int64)]
    for order in ORDERS:
        for start in range(0, max(0, len(flat) - order + 1), BLOCK):
            stop = min(start + BLOCK + order - 1, len(flat))
            bucket, owner = character_grams(flat[start:stop], np.clip(at, start, stop) - start, order, BUCKETS)
            if among is not None:
                some = among[bucket]
                bucket, owner = bucket[some], owner[some]
            parts.append(np.unique(owner.astype(np.int64) * BUCKETS + bucket))
    return np.unique(np.concatenate(parts))


def fit(sample: pa.Table, features: int = 4096, least: int = 5, alpha: float = 1.0, ridge: float = 1e-3, rounds: int = 200) -> NaiveBayesLinear:
    """sample: text and label (1 toxic, 0 clean). One class alone gives its own constant score.

    The features kept are the ``features`` n-grams whose ratios are best supported: held by ``least`` texts or more,
    by the largest chi-square of n-gram and label.
    """
    y = np.array([int(x) for x in sample.column("label").to_pylist()], np.float64)
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        return NaiveBayesLinear(np.zeros(BUCKETS, np.float32), 4.0 if pos else -4.0)
    p, q = np.zeros(BUCKETS), np.zeros(BUCKETS)
    step = 64  # rows whose n-grams are held at once
    texts = sample.column("text").combine_chunks()
    for start in range(0, len(y), step):
        held = presence(*code_points(texts.slice(start, step)))
        toxic = y[start + held // BUCKETS] == 1
        p += np.bincount(held[toxic] % BUCKETS, minlength=BUCKETS)
        q += np.bincount(held[~toxic] % BUCKETS, minlength=BUCKETS)
    ratio = np.log((p + alpha) / (pos + 2 * alpha)) - np.log((q + alpha) / (neg + 2 * alpha))
    n, share = p + q, pos / len(y)
    chi = (p - n * share) ** 2 / np.maximum(n * share * (1 - share) * np.maximum(1 - n / len(y), 1e-9), 1e-9)
    chosen = np.sort(np.argsort(np.where(n >= least, chi, 0))[-features:])
    chosen = chosen[n[chosen] >= least]
    column = np.full(BUCKETS, -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    held = [presence(*code_points(texts.slice(start, step)), column >= 0) + start * BUCKETS for start in range(0, len(y), step)]
    r, c = np.concatenate(held) // BUCKETS, column[np.concatenate(held) % BUCKETS]
    value = ratio[chosen][c]
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)  # both classes count alike, whatever their shares in the sample
    w, b, moment, moment_b = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), 0.0
    scale = max(1.0, float(np.sqrt(np.bincount(r, weights=value**2, minlength=len(y)).mean())))
    rate = 4.0 / scale**2
    for _ in range(rounds):  # gradient descent with momentum
        z = b + np.bincount(r, weights=value * w[c], minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        moment = 0.9 * moment + np.bincount(c, weights=value * g[r], minlength=len(w)) + ridge * w * 0.1
        moment_b = 0.9 * moment_b + g.sum()
        w -= rate * moment
        b -= rate * scale * moment_b
    table = np.zeros(BUCKETS, np.float32)
    table[chosen] = w * ratio[chosen]
    return NaiveBayesLinear(table, float(b))


def score(df: DataFrame, model: NaiveBayesLinear, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of its text column (0 to 1); null texts are scored as empty ones. Rows keep their columns.

    A column of df named like the result is replaced. Texts are scored whole, a very long one alone; equal texts have
    equal scores, and an empty table has none.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats
    kept = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, 1 << 18):
                found = shared.value.score(*code_points(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, out])

    return in_batches(df.select(*[f"`{f.name}`" for f in kept]), run, schema)


def trained(documents: DataFrame, labels: DataFrame, most: int = 2500) -> NaiveBayesLinear:
    """The model of labels.toxic, from about ``most`` rows of each class outside the held-out fold."""
    return fitted(joined_sample(documents, labels.where(~in_fold(crc_mod("doc_id", 3), 1)), "toxic", most), fit)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; nulls, empty texts and repeated rows have their scores too."""
    model = trained(documents, labels)
    fold = in_fold(crc_mod("doc_id", 3), 1)
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
