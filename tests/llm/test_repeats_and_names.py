"""Rows that repeat, samples that depend on rows alone, and columns named like those that operators work with."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_similarity import brute_jaccard

from tessera.llm import jaccard, language, learning, packing, ring, suffixes

DATA = "/root/testdata/sf0.001"
CLASH = ["cell", "first", "stop", "shard", "slot", "_cell", "_rank", "_salt", "_row", "_start", "base", "at", "each", "_cuts", "_doc", "_toxicity", "_text_key", "sequence_id", "offset", "_size", "n", "rank"]


def noted(df):
    return df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASH if c not in df.columns})


def kept(out, but=()):
    return all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in CLASH if c not in but)


def test_operators_keep_columns_named_like_their_own(spark):
    docs = noted(spark.createDataFrame([(i, f"text {i % 4} " * (5 + i % 60)) for i in range(60)], "doc_id long, text string"))
    out = ring.shard_by_ring(docs, F.xxhash64("text"), [F.col("doc_id")], 5)
    assert sorted(out.columns) == sorted(docs.columns) and kept(out, ("shard", "slot")) and out.count() == 60
    assert {(r["shard"], r["slot"]) for r in out.collect()} == {(s, k) for s in range(5) for k in range(12)}
    pieces = noted(packing.tokenized_pieces(docs, *(corpus_pipeline.public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))))
    out = packing.packed(pieces)
    assert kept(out, ("sequence_id", "offset")) and out.where("cast(sequence_id as long) is null").count() == 0
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and kept(out) and out.count() > 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    labels.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/clash-{random.random()}/labels.parquet")
    sf = path.removesuffix("/labels.parquet")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.one_of_each_group):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and kept(out)


@pytest.mark.parametrize("times", [1, 30])
def test_repeated_rows_are_compared_once(spark, monkeypatch, times):
    a = " ".join(f"w{i}" for i in range(100))
    b = a.replace("w0 ", "other ").replace(" w99", " end")
    compared, batches = [], jaccard.in_batches

    def seen(df, run, schema):
        if schema == "a long, b long":
            compared.append(df.count())
        return batches(df, run, schema)

    monkeypatch.setattr(jaccard, "in_batches", seen)
    rows = [(1, a), (2, b)] * times
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert sum(compared) == 1 and len(got) == 2 * times and {(r["doc_id"], r["component_id"]) for r in got} == {(i, c) for i, (_, c) in brute_jaccard([(1, a), (2, b)], 5, 80, 100).items()}


def test_sample_keeps_a_language_of_one_repeated_row(spark):
    rows = [(7, "nur dieser text", "de")] * 3000 + [(100 + i, f"only text {i}", "en") for i in range(25)]
    sample = learning.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", 20).collect()
    assert [r["label"] for r in sample].count("de") == 1 and 15 <= [r["label"] for r in sample].count("en") <= 20


def test_joined_sample_of_one_repeated_id_is_bounded(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(2500)] + [(100 + i, f"other {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0)] + [(100 + i, 0) for i in range(50)] + [(10_000 + i, 1) for i in range(900)], "doc_id long, toxic int")
    sample = learning.joined_sample(docs, labels, "toxic", 20).collect()
    assert [r["label"] for r in sample].count(1) == 20 and 15 <= [r["label"] for r in sample].count(0) <= 20


def test_samples_and_models_do_not_depend_on_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = [sorted((r["doc_id"], r["text"], r["label"]) for r in learning.labelled_sample(docs.repartition(n), "lang", 40).collect()) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and 100 <= len(found[0]) <= 160
    few = docs.where("doc_id < 60")
    texts = few.select("doc_id", "text")
    scores = [{r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(texts, language.trained(few.repartition(n), most=10)).collect()} for n in (1, 4)]
    assert scores[0] == scores[1]


def test_sample_holds_its_bytes(spark):
    rows = [(i, f"{i} " + "word " * 4000, f"l{i % 3}") for i in range(90)] + [(1000, "x" * 300_000, "long")]
    sample = learning.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", 1500, most_bytes=400_000).collect()
    size = {k: sum(len(r["text"]) for r in sample if r["label"] == k) for k in ("l0", "l1", "l2", "long")}
    assert all(0 < n <= 100_000 for n in size.values())
