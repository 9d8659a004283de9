"""Near-duplicate vectors by randomised-rotation binary codes.

A vector o of unit length is turned by a random rotation and kept as the signs of its coordinates: a code, the
vector c = signs / sqrt(d), and the stored factor f = <c, o>. For a turned query q, <c, q> / f is an unbiased
estimate of <o, q>, and as q = <o, q> o + sqrt(1 - <o, q>^2) u with u at right angles to o,

    |<c, q> - f <o, q>| <= sqrt(1 - f^2) sqrt(1 - <o, q>^2) min(1, eps / sqrt(d - 1))

where the share of random rotations that break the bound falls as exp(-eps^2 / 2), and with the 1 none does. Divided by f
it bounds how far the estimate is off. A pair whose estimate and bound together stay below the threshold is dropped on its
code; only the others are computed again from the vectors in double precision.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_batches, written
from tessera.llm.components import components

#: Rows of a tile whose products are held at once.
TILE = 512


#: Confidence of the bounds: a pair over the threshold is lost with a chance of about exp(-18), 2 in 10^8.
EPS = 6.0


@functools.cache
def rotation(dim: int, seed: int = 20240229) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow in the norm
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the turned unit rows of x, and their factors."""
    turned = unit_rows(x) @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def signs(packed: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1


def least_product(factor: np.ndarray, threshold: float, eps: float | None = None, dim: int = 64) -> np.ndarray:
    """<c, q> below this rules out a cosine of threshold; certain without eps."""
    share = 1.0 if eps is None else min(1.0, eps / np.sqrt(max(1, dim - 1)))
    angle = np.arccos(np.clip(factor, -1, 1))
    return threshold * np.cos(angle) - np.sqrt(1 - threshold**2) * np.sin(angle) * share - 1e-5  # float32 products


def estimates(packed: np.ndarray, factor: np.ndarray, queries: np.ndarray, eps: float | None = EPS, cosine: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of coded rows and queries, and how far below a true value of ``cosine`` or more
    they may be at confidence eps (None: at all)."""
    dim = queries.shape[1]
    turned = unit_rows(queries) @ rotation(dim).T
    estimate = (signs(packed, dim) @ turned.T.astype(np.float32)) / np.sqrt(dim) / factor[:, None]
    width = cosine - least_product(factor, cosine, eps, dim) / factor
    return estimate, np.broadcast_to(width[:, None], estimate.shape)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member) after joining the classes of the pairs a, b."""
    pair = np.unique(label[a].astype(np.int64) * len(label) + label[b])
    a, b = pair // len(label), pair % len(label)
    root = np.arange(len(label))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root[label]


def block_links(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, packed: np.ndarray, factor: np.ndarray, left: np.ndarray, threshold: float, eps: float | None) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each row links with in this pair of blocks, and its smallest reachable id here.

    left marks the rows of the first block; if all are (a block with itself), every pair counts once.
    """
    n = len(x)
    order = np.argsort(ids, kind="stable")
    ids, copies, x, packed, factor, left = ids[order], copies[order], x[order], packed[order], factor[order], left[order]
    norm = np.linalg.norm(x, axis=1)
    own = left.all()
    rows, columns = np.flatnonzero(left), np.flatnonzero(left if own else ~left)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for start in range(0, len(rows), TILE):
        some = rows[start : start + TILE]
        estimate, width = estimates(packed[columns], factor[columns], x[some], eps, threshold)
        j, i = np.nonzero(estimate + width >= threshold)
        i, j = some[i], columns[j]
        if own:
            i, j = i[i < j], j[i < j]
        exact = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
        i, j = i[exact], j[exact]
        links += np.bincount(i, weights=copies[j], minlength=n).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=n).astype(np.int64)
        if len(i):
            label = merged(label, i, j)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return links[back], ids[label][back]


def coded(df: DataFrame) -> DataFrame:
    """df (rep, label, dim, copies, embedding as doubles) with its code and factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("dim").to_numpy()
            packed, factor = [b""] * batch.num_rows, np.zeros(batch.num_rows)
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                bits, factor[rows] = codes(batch.column("embedding").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim).astype(np.float64))
                for r, b in zip(rows, bits, strict=True):
                    packed[r] = b.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary()), pa.array(factor)], names=[*batch.schema.names, "code", "factor"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return in_batches(df, run, f"{kinds}, code binary, factor double")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, block: int = 4096, eps: float | None = EPS) -> DataFrame:
    """vec_id, n_links, component_id, kept: links between vectors of equal label with cosine >= threshold.

    Vectors that are null, zero or hold null or non-finite components, and those of null label, link with nothing;
    vectors of different length neither. Rows without vec_id have no identity and are left out; rows that repeat a
    vec_id count once, by the smallest (label, embedding). An empty table gives no rows; columns other than
    vec_id, label and embedding, whatever their names, play no part. eps is the confidence of the bounds that decide which
    pairs are computed exactly; None takes the certain bound, with which no link is ever lost.

    Exact copies are collapsed before any comparison, so their number costs nothing. A label's other vectors are dealt
    to blocks of about ``block`` rows by a hash; every pair of its blocks is one group of the shuffle, of bounded size,
    so a label that holds a third of all rows makes more groups and not larger ones. A group returns one row per
    linked vector, never its pairs.
    """
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    one = embeddings.where(F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    sound = F.coalesce(F.col("label").isNotNull() & F.forall("embedding", number) & F.exists("embedding", lambda x: x.cast("double") != 0), F.lit(False))
    keyed = one.select("vec_id", "label", "embedding", sound.alias("sound"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("k2"))
    key = ["label", "k1", "k2"]
    groups = keyed.where("sound").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by(F.col("embedding").cast("array<double>"), "vec_id").alias("embedding"))
    groups = written(groups, "vectors")
    reps = coded(groups.select("rep", "label", F.size("embedding").alias("dim"), "copies", "embedding"))
    blocks = groups.groupBy("label", F.size("embedding").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = reps.join(blocks, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dim", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "rep", "copies", "embedding", "code", "factor", (F.col("own") <= F.col("other")).alias("left")
    )

    def run(table: pa.Table) -> pa.Table:
        n, dim = table.num_rows, table.column("dim")[0].as_py()
        ids = table.column("rep").to_numpy()
        x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
        packed = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(n, -1)
        links, root = block_links(ids, table.column("copies").to_numpy(), x, packed, table.column("factor").to_numpy(), table.column("left").to_numpy(zero_copy_only=False), threshold, eps)
        some = links > 0
        return pa.table({"rep": ids[some], "links": links[some], "root": root[some]})

    found = written(pairs.groupBy("label", "dim", "bi", "bj").applyInArrow(run, "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    of_rep = groups.select(*key, "rep", "copies").join(links, "rep", "left").join(classes, "rep", "left")
    joined = keyed.select("vec_id", F.when(F.col("sound"), F.col("label")).alias("label"), "k1", "k2").join(of_rep, key, "left")
    component = F.coalesce("component", "rep", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )
