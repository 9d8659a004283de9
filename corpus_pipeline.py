"""A corpus pipeline of five stages, each calling one of the operators on all that the stage before it kept.

Every stage function takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which returns
where each piece of each document stands in the packed sequences. Between stages the rows are a written table in the
shared folder, so each stage reads files and a lost executor costs no more than a task.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, packing, suffixes, toxicity
from tessera.llm.common import unused, written

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC; trained on the labels of the documents that are there.

    Null and empty texts have the score of a text without n-grams; repeated rows and rows of null doc_id are scored by
    their texts like any other. Without labels nothing is toxic; an empty table stays empty.
    """
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (out,) = unused(docs, "_toxicity")
    return toxicity.score(docs, model, out=out).where(F.col(out) < TOXIC).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, with enough confidence.

    Null texts and texts without a letter have no language and go. Where no document carries a language nothing is
    known, so all go. Repeated rows and null ids play no part in the decision; an empty table stays empty.
    """
    return language.identify(docs, language.trained(docs)).where(~F.col("rejected")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that are alike in 0.8 of their five-word shingles, the one of the smallest doc_id.

    Rows of one doc_id and different texts are documents of their own (of those in one class the least hash of the text
    stays); of those that repeat a doc_id and text one stays. Documents of null doc_id stay, copies of one text as one,
    and so do null and empty texts. An empty table stays empty.
    """
    alike = jaccard.similar_classes(docs, words=5, num=80, den=100).where("doc_id is not null and class_id is not null")
    found = written(alike.select("doc_id", "text_key", "class_id"), "alike")
    row, (key,) = F.struct("doc_id", "text_key"), unused(docs, "_text_key")
    first = found.groupBy("class_id").agg(F.min(row).alias("first"))
    gone = found.join(first, "class_id").where(row != F.col("first")).select("doc_id", F.col("text_key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("text"))
    return keyed.join(gone, ["doc_id", key], "left_anti").dropDuplicates(["doc_id", key]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that stand earlier in the corpus.

    Null and empty texts, rows of null doc_id and rows whose doc_id another text also has stay as they are.
    """
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset in sequences of 2048 tokens.

    Null and empty texts are the end id alone; null ids and repeated rows are packed like any other.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Trained models and the byte-pair vocabulary have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
