"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams; a linear layer gives one logit for each language.
Both are trained together by stochastic gradient descent in numpy on a bounded labelled sample. As the model is
linear in the mean, embeddings and layer fold into one table of logits for prediction: the mean of the table's rows
over the whole text.

Rejection is calibrated on windows of 10 to 200 bytes, and whole texts, of rows that training did not see. The mean of few
n-grams says less than that of many, so logits are multiplied by ``gain * n ** growth`` of n n-grams, both fitted by the
windows' log loss: probabilities are then as high as predictions are often right, at any length. Probabilities cannot tell
a language that is none of the learned ones, so a text is also rejected if fewer of its n-grams than a floor, again by
length, occur in the sample's texts of the predicted language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, crc_mod, flat_bytes, in_batches
from tessera.llm.grams import LOWER, byte_grams
from tessera.llm.learning import fitted, in_fold, labelled_sample

ORDERS = (2, 3, 4)
#: Orders of which a foreign text has many n-grams that a language's texts lack.
TELLING = (3, 4)
BUCKETS = 1 << 16
#: Lengths in bytes of the windows of held-out rows on which rejection is calibrated; whole texts come on top.
WINDOWS = (10, 20, 40, 80, 200)
#: No floor is above this: a few unseen n-grams (an address, a key) make no text foreign.
HIGHEST_FLOOR = 0.8
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Every byte that can be no part of a letter is a space to the n-grams: marks, digits and white space say little.
FOLD = LOWER.copy()
FOLD[:128][~((np.arange(128) >= 97) & (np.arange(128) <= 122) | (np.arange(128) >= 65) & (np.arange(128) <= 90))] = 32


def logits_mean(flat: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The mean over each text's n-grams of table's rows (BUCKETS x k), the numbers of n-grams, and buckets and owners of the
    n-grams of TELLING orders. Texts without n-grams have zeros."""
    n, k = len(at) - 1, table.shape[1]
    total, count, telling = np.zeros((n, k)), np.zeros(n), []
    folded = FOLD[flat]
    for order in ORDERS:
        bucket, owner = byte_grams(folded, at, order, BUCKETS)
        count += np.bincount(owner, minlength=n)
        for j in range(k):
            total[:, j] += np.bincount(owner, weights=table[:, j][bucket], minlength=n)
        if order in TELLING:
            telling.append((bucket, owner))
    return total / np.maximum(count, 1)[:, None], count, telling


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages: embeddings times layer; or embeddings
    bias: np.ndarray
    threshold: float
    layer: np.ndarray | None = None  # of more languages than the embeddings have numbers: the layer, kept apart
    gain: float = 1.0
    growth: float = 0.0
    seen: np.ndarray | None = None  # BUCKETS x languages, packed to bits: whether the language's texts have the bucket
    floors: tuple[tuple[float, ...], tuple[float, ...]] = ((0.0,), (0.0,))  # log counts of n-grams, and floors there

    def measures(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Logits before calibration, numbers of n-grams (1 at least), and what ``coverage`` takes."""
        mean, count, telling = logits_mean(flat, at, self.table)
        return (mean if self.layer is None else mean @ self.layer) + self.bias, np.maximum(count, 1), telling

    def sharpened(self, z: np.ndarray, count: np.ndarray) -> np.ndarray:
        return softmax(z * (self.gain * count**self.growth)[:, None])

    def coverage(self, telling: list[tuple[np.ndarray, np.ndarray]], best: np.ndarray) -> np.ndarray:
        """The share of each text's n-grams that texts of its language have; 1 of texts without n-grams."""
        have, all_ = np.zeros(len(best)), np.zeros(len(best))
        for bucket, owner in telling:
            lang = best[owner]
            bit = (self.seen[bucket, lang >> 3] >> (7 - (lang & 7)).astype(np.uint8)) & 1
            have += np.bincount(owner, weights=bit, minlength=len(best))
            all_ += np.bincount(owner, minlength=len(best))
        return np.where(all_ > 0, have / np.maximum(all_, 1), 1.0)

    def predict(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the likeliest language, its calibrated probability, and whether the text is rejected."""
        z, count, telling = self.measures(flat, at)
        best = z.argmax(axis=1)
        top = self.sharpened(z, count).max(axis=1)
        foreign = self.coverage(telling, best) < np.interp(np.log(count), *self.floors)
        return best, top, (top < self.threshold) | foreign


def fit(sample: pa.Table, dim: int = 16, epochs: int = 12, rate: float = 0.5, tolerated: float = 0.0005, window: int = 2000, seed: int = 7) -> LanguageModel:
    """sample: text and label. Every fifth row is kept from training, for the calibration.

    In training each text is represented by one window of its bytes in each epoch, at a random place; predictions
    use whole texts. Without rows the model knows no language and calls everything unknown.
    """
    names = tuple(sorted({str(x) for x in sample.column("label").to_pylist()}))
    if not names:
        return LanguageModel((), np.zeros((BUCKETS, 0)), np.zeros(0), 0.0)
    number = {name: i for i, name in enumerate(names)}
    y = np.array([number[str(x)] for x in sample.column("label").to_pylist()])
    flat, at = flat_bytes(sample.column("text").combine_chunks())
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, learn = (order[::5], order[np.arange(len(order)) % 5 != 0]) if len(y) >= 20 else (order, order)
    embed, layer, bias = rng.normal(0, 1 / dim, (BUCKETS, dim)), np.zeros((dim, len(names))), np.zeros(len(names))
    share = np.bincount(y[learn], minlength=len(names)) / max(1, len(learn))
    weight = 1 / np.maximum(share * len(names), 1e-9)  # languages count alike
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(learn)
        for start in range(0, len(learn), 32):
            rows = learn[start : start + 32]
            lo = at[rows] + (rng.random(len(rows)) * np.maximum(at[rows + 1] - at[rows] - window, 0)).astype(np.int64)
            cut = [flat[a : min(a + window, b)] for a, b in zip(lo, at[rows + 1], strict=True)]
            some, places = FOLD[np.concatenate(cut)], np.concatenate([[0], np.cumsum([len(c) for c in cut])])
            grams = [byte_grams(some, places, n, BUCKETS) for n in ORDERS]
            bucket, owner = np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])
            size = np.maximum(np.bincount(owner, minlength=len(rows)), 1)
            pair, times = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            owner, bucket = pair // BUCKETS, pair % BUCKETS
            part = times / size[owner]
            hidden = np.stack([np.bincount(owner, weights=part * embed[bucket, j], minlength=len(rows)) for j in range(dim)], axis=1)
            p = softmax(hidden @ layer + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = p * weight[y[rows]][:, None] / len(rows)
            back = g @ layer.T
            layer -= step * 20 * hidden.T @ g
            bias -= step * 0.1 * g.sum(axis=0)
            if len(bucket):
                by = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
                embed[bucket[by][starts]] -= np.add.reduceat((step * 200 * part[:, None] * back[owner])[by], starts, axis=0)
    seen = np.zeros((BUCKETS, len(names)), bool)
    texts = sample.column("text").combine_chunks()
    for lang in range(len(names)):
        times = np.zeros(BUCKETS, np.int64)
        rows = learn[y[learn] == lang]
        for start in range(0, len(rows), 256):
            some, places = flat_bytes(texts.take(pa.array(rows[start : start + 256])))
            for n in TELLING:
                times += np.bincount(byte_grams(FOLD[some], places, n, BUCKETS)[0], minlength=BUCKETS)
        seen[:, lang] = times > 1
    apart = len(names) > dim
    table, after = (embed, layer) if apart else (embed @ layer, None)
    model = LanguageModel(names, table, bias, 0.0, after, seen=np.packbits(seen, axis=1))
    return calibrated(model, texts.take(pa.array(held)), y[held], tolerated, rng)


def windows_of(flat: np.ndarray, at: np.ndarray, width: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One window of about ``width`` bytes, at a random character, of each text longer than that; and the texts' numbers."""
    rows = np.flatnonzero(np.diff(at) > width)
    lo = at[rows] + (rng.random(len(rows)) * (np.diff(at)[rows] - width)).astype(np.int64)
    for _ in range(3):  # bytes 10xxxxxx go on with a character
        lo += (flat[lo] & 0xC0) == 0x80
    parts = [flat[a : a + width] for a in lo]
    return np.concatenate([*parts, np.zeros(0, np.uint8)]), np.arange(len(rows) + 1) * width, rows


def calibrated(model: LanguageModel, texts: pa.Array, y: np.ndarray, tolerated: float, rng: np.random.Generator) -> LanguageModel:
    """model with gain, growth, threshold and floors from texts that it did not learn from, and their languages' numbers.

    The threshold lets a text pass that is likelier named right than not, and all but the share ``tolerated`` of whole texts.
    A floor lets twice the unseen n-grams pass that all but that share of the texts, and windows, of a length have.
    """
    z, count, cover, true, marks, floors = [], [], [], [], [], []
    for width in (*WINDOWS, None):
        cz, cn, cc, cy = [], [], [], []
        for start in range(0, len(texts), 512):
            flat, at = flat_bytes(texts.slice(start, 512))
            rows = np.arange(len(at) - 1)
            if width is not None:
                flat, at, rows = windows_of(flat, at, width, rng)
            if len(rows):
                logits, n, telling = model.measures(flat, at)
                cz.append(logits)
                cn.append(n)
                cc.append(model.coverage(telling, y[start + rows]))
                cy.append(y[start + rows])
        if cz:
            z, count, true = [*z, np.concatenate(cz)], [*count, np.concatenate(cn)], [*true, np.concatenate(cy)]
            cover = np.concatenate(cc)
            marks.append(float(np.log(np.median(count[-1]))))
            floors.append(min(HIGHEST_FLOOR, max(0.0, 1 - 2 * (1 - float(np.quantile(cover, tolerated))))))
    all_z, all_n, all_y = np.concatenate(z), np.concatenate(count), np.concatenate(true)

    def loss(fit: tuple[float, float]) -> float:
        p = softmax(all_z * (fit[0] * all_n ** fit[1])[:, None])
        return float(-np.log(p[np.arange(len(all_y)), all_y] + 1e-12).mean())

    gain, growth = min(((2.0**a, b) for a in np.arange(-6, 6.01, 0.5) for b in np.arange(0, 1.01, 0.1)), key=loss)
    whole = softmax(z[-1] * (gain * count[-1] ** growth)[:, None]).max(axis=1)
    order = np.argsort(marks, kind="stable")
    marks, floors = np.array(marks)[order], np.maximum.accumulate(np.array(floors)[order])
    threshold = min(0.5, 0.8 * float(np.quantile(whole, tolerated)))
    return replace(model, gain=float(gain), growth=float(growth), threshold=threshold, floors=(tuple(marks), tuple(floors)))


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df with lang_pred, score (probability of lang_pred, 0 where unknown) and rejected.

    Null texts and texts without a letter are ``und`` with score 0, and rejected. A text whose best probability is
    below the model's threshold, or too few of whose n-grams its language has, keeps its language and is rejected. Of equal
    probabilities the language first by name counts. Texts are taken whole, a very long one alone; repeated rows have equal
    results, an empty table has none, and a model without languages calls every text ``und``. Columns of df with these names
    are replaced, all others kept.
    """
    # BUCKETS x languages floats and bits, or BUCKETS x dim floats of more languages than dim
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "score", "rejected")
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in chunks(batch, text, 1 << 18):
                known = np.array([bool(model.languages and x and LETTER.search(x)) for x in part.column(text).to_pylist()], bool)
                if model.languages:
                    best, top, rejected = model.predict(*flat_bytes(part.column(text)))
                else:
                    best, top, rejected = (np.zeros(part.num_rows, kind) for kind in (np.int64, np.float64, bool))
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, top, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score), pa.array(~known | rejected)], names=[*part.schema.names, *new])

    return in_batches(df.select(*[f"`{f.name}`" for f in kept]), run, schema)


def trained(documents: DataFrame, most: int = 1500) -> LanguageModel:
    """The model of lang, from about ``most`` rows of each language outside the held-out fold."""
    known = documents.where(~in_fold(crc_mod("doc_id", 4), 2))
    return fitted(labelled_sample(known, "lang", most), fit)


def languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row, repeated ones included."""
    model = trained(documents)
    fold = in_fold(crc_mod("doc_id", 4), 2)
    return identify(documents.select("doc_id", "text"), model).select("doc_id", fold.alias("held_out"), "lang_pred", "score", "rejected")
