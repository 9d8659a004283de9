"""Bounded labelled samples for the classifiers that are trained here, and their training in a task."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import give_back, written

#: Values of a label that have a sample of full size each; more values share the rows of so many equally.
CLASSES = 64
#: Bytes of text of a sample.
MOST_BYTES = 24 << 20
#: Parts of the hash range by which rows are chosen.
PARTS = 1 << 30


def thinned(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Rows (label, h: a hash of what tells them apart, ...) of which about twice ``most`` (or all) of each label value are left, and the rows that a value is to have.

    Rows are chosen by their hashes against the value's number of rows; the one of least hash is always among them, so no
    value is left out, whatever repeats. Of more than CLASSES values each has as many rows fewer as keeps the total.
    """
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()  # a row for each label value
    each = max(1, min(most, CLASSES * most // max(1, len(counts))))
    kind = rows.schema["label"].dataType.simpleString()
    limits = rows.sparkSession.createDataFrame([(r["label"], int(PARTS * min(1.0, 2 * each / r["n"])), r["least"]) for r in counts], f"label {kind}, _limit long, _least long")
    near = (F.pmod("h", F.lit(PARTS)) < F.col("_limit")) | (F.col("h") == F.col("_least"))
    return rows.join(F.broadcast(limits), "label").where(near).drop("_limit", "_least"), each


def bounded(near: DataFrame, each: int, most_bytes: int) -> DataFrame:
    """doc_id, text, label of near (with h): at most ``each`` different rows of a label value and its share of most_bytes, by ascending hash.

    Equal rows count once. Of a very long text the beginning counts, and a value's first row is cut to the share if it is
    longer. What is chosen depends on the rows alone, not on their order or partitioning; a task may hold all of it.
    """
    size = F.octet_length("text")
    text = F.when(size <= most_bytes // 32, F.col("text")).otherwise(F.substring("text", 1, most_bytes // 128))
    few = written(near.select("label", "h", "doc_id", text.alias("text")).dropDuplicates(["label", "h"]), "sample")
    share = most_bytes // max(1, few.select("label").distinct().count())
    order = Window.partitionBy("label").orderBy("h")
    rows = few.withColumns({"_rank": F.row_number().over(order), "_bytes": F.sum(F.octet_length("text")).over(order)})
    first = (F.col("_rank") == 1) & (F.col("_bytes") > share)
    kept = rows.where((F.col("_rank") <= each) & ((F.col("_bytes") <= share) | first))
    return kept.select("doc_id", F.when(first, F.substring("text", 1, max(1, share // 4))).otherwise(F.col("text")).alias("text"), "label")


def within(table: pa.Table, most_bytes: int) -> pa.Table:
    """text and label of a sample, in an order that depends on the rows alone: at most ``most_bytes`` of text.

    All values have equal shares; one none of whose texts fits into its share has the beginning of one.
    """
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    values = table.column("label").to_pylist()
    share, used, keep, cut = most_bytes // max(1, len(set(values))), {}, [], {}
    for i, (value, n) in enumerate(zip(values, (len(x.as_py()) for x in table.column("text").cast(pa.binary())), strict=True)):
        used[value] = used.get(value, 0) + n
        if used[value] <= share:
            keep.append(i)
        elif used[value] == n:  # its first text
            keep.append(i)
            cut[len(keep) - 1] = max(1, share)
    found = table.take(pa.array(keep, pa.int64())).drop_columns(["doc_id"])
    if not cut:
        return found
    texts = found.column("text").to_pylist()
    for i, n in cut.items():
        texts[i] = texts[i].encode()[:n].decode(errors="ignore")
    return found.set_column(found.schema.get_field_index("text"), "text", pa.chunked_array([pa.array(texts, found.schema.field("text").type)]))


def labelled_sample(documents: DataFrame, label: str, most: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The sample of documents that carry the label themselves; rows without label, id or text are none of it."""
    known = documents.select("doc_id", "text", F.col(label).alias("label")).dropna()
    return bounded(*thinned(known.withColumn("h", F.xxhash64(F.lit("sample"), "doc_id", "text")), most), most_bytes)


def joined_sample(documents: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The sample of documents whose label is in another table; repeated labels of an id count once, by the largest.

    Ids of documents that are there are chosen first, so only about twice ``most`` of each value are broadcast and no other text is
    shuffled. Rows of a chosen id are then bounded like any.
    """
    there = documents.where("doc_id is not null and text is not null").select("doc_id").distinct()
    one = labels.select("doc_id", F.col(label).alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    ids, each = thinned(one.join(there, "doc_id", "left_semi").withColumn("h", F.xxhash64(F.lit("sample"), "doc_id")), most)
    rows = documents.select("doc_id", "text").dropna().join(F.broadcast(ids.select("doc_id", "label")), "doc_id")
    return bounded(rows.withColumn("h", F.xxhash64(F.lit("sample"), "doc_id", "text")), each, most_bytes)


def fitted(sample: DataFrame, fit: Callable[[pa.Table], Any], most_bytes: int = MOST_BYTES) -> Any:
    """fit(table of text and label) of the sample, run in one task; the driver sees the model and no text.

    A lost executor costs the task, which gives the same model again. A sample without rows is fitted as such.
    """

    def train(table: pa.Table) -> pa.Table:
        model = pickle.dumps(fit(within(table, most_bytes)))
        give_back()
        return pa.table({"model": pa.array([model], pa.binary())})

    rows = sample.groupBy().applyInArrow(train, "model binary").collect()
    if rows:
        return pickle.loads(rows[0]["model"])
    return fit(pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.string())}))


def in_fold(column: Column, fold: int) -> Column:
    return F.coalesce(column == F.lit(fold), F.lit(False))
