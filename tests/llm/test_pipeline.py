"""The stages one by one, each against what it is asked to do, and the whole."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_codecs import check_packing
from test_similarity import brute_jaccard, brute_repeats

from tessera.llm import packing

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        assert docs.columns == names
        kept[name] = (before, {r["doc_id"]: r for r in docs.collect()})
    before, after = kept["toxicity"]
    gone = set(before) - set(after)
    assert not [i for i in gone if labels.get(i) == 0] and all(after[i] == before[i] for i in after)
    before, after = kept["language_id"]
    assert len(after) >= 0.99 * len(before)
    before, after = kept["ngram_jaccard_join"]
    classes = brute_jaccard([(i, r["text"]) for i, r in before.items()], 5, 80, 100)
    assert set(after) == {c for _, c in classes.values()} and all(after[i] == before[i] for i in after)
    before, after = kept["suffix_array_dedup"]
    held = brute_repeats([(i, r["text"]) for i, r in before.items()], 50)
    assert set(after) == {i for i, h in held.items() if not h or not all(h)}
    assert all((after[i]["text"] == before[i]["text"]) == (not any(held[i])) for i in after)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    plain = packing.tokenizer(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    check_packing([(r["doc_id"], r["piece"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in rows], {i: len(plain.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in after.items()}, 2048)
    whole = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(map(str, whole)) == sorted(map(str, rows))


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(4)
    some = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    a, b, passage = " ".join(some(90)), " ".join(some(90)), some(60)
    rows = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, None), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as text_key")
    out = corpus_pipeline.one_of_each_group(spark, docs, DATA)
    assert out.columns == docs.columns
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([(3, a), (5, b), (None, a), (None, None), (8, None), (9, "")], "doc_id long, text string").collect()))
    rows = [(1, " ".join(passage)), (2, " ".join([*some(20), *passage, *some(30)])), (3, a), (3, " ".join([*some(5), *passage])), (4, " ".join(passage)), (None, " ".join(passage)), (6, None)]
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()]
    kept = {x for x in out if x[0] != 2}
    assert kept == {x for x in rows if x[0] not in (2, 4)} and len(out) == 6
    assert [len(t.split()) for i, t in out if i == 2] == [50]


def test_stages_of_odd_and_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for rows in (docs.where("false"), docs.limit(40).withColumn("text", F.when(F.col("doc_id") % 3 != 0, F.col("text")))):
        rows = corpus_pipeline.written(rows, "odd")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = corpus_pipeline.written(stage(spark, rows, DATA), name)
            assert rows.columns == docs.columns
        assert corpus_pipeline.pack(spark, rows, DATA).count() >= rows.count()
