"""Sinks and readers of other formats than parquet, bucketed and partitioned tables, and rows that a reader can't parse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.sources.written import fresh_path

#: Options with which a table comes back as it was: nulls beside empty texts, quotes and line ends within texts.
OPTIONS: dict[str, dict[str, str]] = {
    "parquet": {},
    "orc": {},
    "json": {"ignoreNullFields": "false"},
    "csv": {"header": "true", "nullValue": "\\N", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"},
    "xml": {"rowTag": "row", "rootTag": "rows", "nullValue": "\\N", "ignoreSurroundingSpaces": "false"},
}
#: Where a reader puts a row that it can't parse, whole.
CORRUPT = "_corrupt_record"


def stored(df: DataFrame, kind: str, path: str | None = None) -> DataFrame:
    """df written in a format and read back with its own schema. csv and xml hold plain columns only; empty texts and nulls stay apart."""
    path = path or fresh_path(df.sparkSession, kind)
    df.write.format(kind).options(**OPTIONS[kind]).save(path)
    return df.sparkSession.read.format(kind).options(**OPTIONS[kind]).schema(df.schema).load(path)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """rows, lost, added: rows of a, those that b holds less often, and those that b holds more often, copies counted. One shuffle of hashes' counts.

    Rows are compared by two 64-bit hashes of all columns, so a null, an empty text and a missing row are told apart.
    """
    row = F.struct(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in a.columns])
    key = lambda df, n: df.select(F.xxhash64(row).alias("h"), F.xxhash64(F.lit("again"), row).alias("g"), F.lit(n).alias("d"))
    counts = key(a, 1).unionAll(key(b, -1)).groupBy("h", "g").agg(F.sum("d").alias("d"), F.count_if(F.col("d") > 0).alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counts.agg(total("n").alias("rows"), total(F.greatest(F.col("d"), F.lit(0))).alias("lost"), total(F.greatest(-F.col("d"), F.lit(0))).alias("added"))


def parsed_or_kept(lines: DataFrame, schema: StructType, kind: str = "json", path: str | None = None) -> DataFrame:
    """Lines of text (value) as rows of schema and CORRUPT: null, or the whole line where it can't be parsed. No line is lost."""
    path = path or fresh_path(lines.sparkSession, "lines")
    lines.select("value").write.text(path)
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return lines.sparkSession.read.format(kind).schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).load(path)


def bucketed(df: DataFrame, by: str, buckets: int, name: str = "bucketed") -> DataFrame:
    """df as a table dealt and sorted by ``by``: joins and aggregates by it with tables of as many buckets need no shuffle.

    One task writes a bucket of its own, so there is a file for each bucket and not for each task and bucket.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def partitioned(df: DataFrame, by: list[str], path: str | None = None) -> DataFrame:
    """df as files in a folder for each value of ``by``: filters on it read those folders only."""
    path = path or fresh_path(df.sparkSession, "partitioned")
    df.repartition(*by).write.partitionBy(*by).parquet(path)
    spark: SparkSession = df.sparkSession
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
