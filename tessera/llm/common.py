"""What the corpus operators share: the written-table cut of lineage, flat views of Arrow text, gapless ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once.
CHUNK_BYTES = 4 << 20
#: The setting for bytes of an Arrow batch between Spark and Python, and its value where the session has none: batches
#: of 10000 rows, Spark's own bound, hold any number of bytes.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; one of this machine only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: later stages read the files, so lost executors cost no more than a read."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tessera_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no plan still to be run reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._tessera_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the machine, where the C library can: a reused Python worker would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in bounded memory: batches of BATCH_BYTES, and freed memory given back after a task.

    A longer row is a batch of its own, whole. Where the session sets the size of batches, that size holds.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(bounded, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores before those that df has a column of: work columns that clash with none of its own."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null ids give -1, which no fold has."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % F.lit(divisor), F.lit(-1)).cast("int")


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary array in one run, and the n + 1 places where its values begin; null is empty."""
    values = values.cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    n = len(values)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = values.buffers()
    at = np.frombuffer(starts, np.int64)[values.offset : values.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about limit bytes of the column; a longer value stands alone, whole."""
    n = batch.num_rows
    if not n:
        return
    size = np.frombuffer(batch.column(column).cast(pa.large_binary()).fill_null(b"").buffers()[1], np.int64)[: n + 1] if n else np.zeros(1)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(size, size[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def list_column(flat: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from a flat run and its n + 1 starts."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, kind))


def joined_unevenly(rows: DataFrame, side: DataFrame, on: list[str], n: str, most: int = 1 << 16, hot: int = 1000) -> DataFrame:
    """rows.join(side, on), where side has one row for each key and counts the rows of the key in column n.

    No key's rows meet in one task: the ``most`` most frequent keys (of those with ``hot`` rows or more) are broadcast, and
    their rows stay where they are. Others, each with fewer rows than one part in ``most``, are joined by a shuffle. Both
    tables are read several times, so they are written tables or plans whose rows are always the same.
    """
    often = side.where(F.col(n) >= hot).orderBy(F.desc(n), *on).limit(most)
    found = rows.join(F.broadcast(often), on)
    keys = often.select(*on)
    rest = rows.join(F.broadcast(keys), on, "left_anti").join(side.join(F.broadcast(keys), on, "left_anti"), on)
    return found.unionByName(rest)


def ranked(df: DataFrame, key: list[str], order: list[Column], salt: Column, salts: int = 256, rank: str = "rank") -> DataFrame:
    """Gapless ranks from 0 within each key, without one task for a key that holds a large share of the rows.

    A key's rows are dealt to salts parts; counts by part, summed before they are shuffled, give each part its
    first rank, and a window numbers the rows within a part. Rows that tie in order are told apart arbitrarily.
    """
    part, first, nth = unused(df, "_salt", "_start", "_row")
    parts = df.withColumn(part, F.pmod(salt, F.lit(salts)).cast("int"))
    before = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(*key, part).agg(F.count(F.lit(1)).alias(nth))
    starts = counts.select(*key, part, F.coalesce(F.sum(nth).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(*key, part).orderBy(*order)
    numbered = parts.withColumn(nth, F.row_number().over(within) - 1)
    return numbered.join(starts, [*key, part]).withColumn(rank, F.col(first) + F.col(nth)).drop(part, first, nth)
