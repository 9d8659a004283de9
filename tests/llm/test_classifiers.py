"""Held-out accuracy of the classifiers, and rows that are odd."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language, learning, quality, toxicity
from tessera.llm import queries as registered
from tessera.llm.grams import byte_grams, character_grams, code_points
from tessera.llm.common import flat_bytes

DATA = "/root/testdata/sf0.01"
ODD = [None, "", "\n\t 12 !?", "x", "z" * 200_000, "same text here", "same text here"]


def odd_rows(spark):
    rows = [(i, t, "en", 0.5, None) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, rejected boolean")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_grams_stay_within_their_text():
    flat, at = flat_bytes(pa.array(["abcd", None, "", "ab", "abcd", "xyz"]))
    bucket, owner = byte_grams(flat, at, 3, 1 << 16)
    assert owner.tolist() == [0, 0, 4, 4, 5] and bucket[:2].tolist() == bucket[2:4].tolist()


def test_character_grams_are_of_folded_code_points():
    flat, at = code_points(pa.array(["STRASSE", None, "straße", "ÄÖÜ", "äöü", "日本語", "xäöü"]))
    assert at.tolist() == [0, 7, 7, 14, 17, 20, 23, 27]
    bucket, owner = character_grams(flat, at, 3, 1 << 20)
    of = {i: bucket[owner == i].tolist() for i in range(7)}
    assert of[0] == of[2] and len(of[0]) == 5 and of[3] == of[4] and len(of[5]) == 1 and of[1] == [] and of[6][1:] == of[4]
    assert character_grams(*code_points(pa.array(["ab", None])), 3, 1 << 20)[0].tolist() == []


def test_presence_does_not_depend_on_blocks(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.choice([0, 1, 3, 5, 9, 40, 300]))) for _ in range(60)] + [None]
    flat, at = code_points(pa.array(texts))
    whole = toxicity.presence(flat, at)
    want = {(i, t[k : k + n]) for i, t in enumerate(texts) if t for n in toxicity.ORDERS for k in range(len(t) - n + 1)}
    assert abs(len(whole) - len(want)) <= 0.01 * len(want)  # n-grams that share a bucket
    for block in (1, 7, 64):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert (toxicity.presence(flat, at) == whole).all()


def sample_of(spark, without=None):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect() if fold(r["doc_id"], 4) != 2 and r["lang"] != without]
    return pa.table({"text": [t for t, _ in rows], "label": [label for _, label in rows]})


def held_texts(spark):
    return [(r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if fold(r["doc_id"], 4) == 2]


FOREIGN = [
    "De snelle bruine vos springt over de luie hond terwijl de kinderen in de tuin spelen en hun ouders koffie drinken.",
    "La rapida volpe marrone salta sopra il cane pigro mentre i bambini giocano nel giardino e i genitori bevono il caffè.",
    "Szybki brązowy lis przeskakuje nad leniwym psem, podczas gdy dzieci bawią się w ogrodzie.",
    "素早い茶色の狐がのろまな犬を飛び越える間、子供たちは庭で遊び、両親はテラスでコーヒーを飲んでいます。",
    "Быстрая коричневая лиса прыгает через ленивую собаку, пока дети играют в саду.",
    "xqzv wkjpt bnmrgh qqwzx plkjh vbnmc zxcvq wrtyp sdfgh jklmn pqrst vwxyz bcdfg",
]


def test_foreign_texts_are_rejected_and_confidence_is_accuracy(spark):
    model, held = language.fit(sample_of(spark)), held_texts(spark)
    assert model.predict(*flat_bytes(pa.array(FOREIGN)))[2].all()
    for chars, error in ((10, 0.06), (20, 0.06), (40, 0.04), (None, 0.02)):
        best, score, rejected = model.predict(*flat_bytes(pa.array([t[:chars] for t, _ in held])))
        right = np.array([model.languages[b] == lang for b, (_, lang) in zip(best, held, strict=True)])
        assert abs(score.mean() - right.mean()) <= error
        assert (rejected & right).mean() < 0.02


def test_a_language_left_out_of_training_is_rejected(spark):
    model, held = language.fit(sample_of(spark, without="de")), held_texts(spark)
    rejected = model.predict(*flat_bytes(pa.array([t for t, lang in held if lang == "de"])))[2]
    kept = ~model.predict(*flat_bytes(pa.array([t for t, lang in held if lang != "de"])))[2]
    assert "de" not in model.languages and rejected.mean() > 0.9 and kept.mean() > 0.98


def test_language_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = registered.op4_language(spark, DATA).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) > 0.98 * len(held)
    assert sum(r["rejected"] for r in rows) < 0.01 * len(rows)


def test_language_of_odd_rows(spark):
    model = language.trained(spark.read.parquet(f"{DATA}/documents.parquet"))
    rows = language.identify(odd_rows(spark), model).collect()
    assert len(rows) == len(ODD) + 1
    by = {r["doc_id"]: r for r in rows}
    for i in (0, 1, 2):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[3]["lang_pred"] != "und" and by[5]["score"] == by[6]["score"] and by[5]["lang"] == "en"
    none = odd_rows(spark).where("false")
    assert language.languages(none).count() == 0
    untrained = language.languages(odd_rows(spark).drop("lang").selectExpr("*", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in untrained.collect()} == {"und"}


def accuracy(spark, rows, column, n, held_out):
    label = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["doc_id"] in label and fold(r["doc_id"], n) == held_out]
    return held


def test_toxicity_query(spark):
    rows = registered.op8_toxicity(spark, DATA).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = accuracy(spark, rows, "toxic", 3, 1)  # a few dozen toxic rows are all there is to learn from here
    assert sum(p == y for p, y in held) > 0.9 * len(held) and sum(p for p, y in held if not y) <= 0.03 * len(held)


def test_toxicity_finds_what_the_labels_show(spark):
    """Of held-out toxic documents, those that hold a word no clean labelled one holds, and that many toxic ones do."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["doc_id"] in texts}
    words = {i: set(texts[i].casefold().replace(",", " ").replace(".", " ").split()) for i in label}
    telling = {w for i, y in label.items() if y for w in words[i] if sum(w in words[k] for k, z in label.items() if z) >= 8}
    telling -= {w for i, y in label.items() if not y for w in words[i]}
    held = [r for r in registered.op8_toxicity(spark, DATA).collect() if r["held_out"] and label.get(r["doc_id"]) and words[r["doc_id"]] & telling]
    assert len(held) >= 10 and sum(r["predicted"] for r in held) >= 0.9 * len(held)


def test_toxicity_learns_words_in_long_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 8)))
    make = lambda bad: " ".join([word() for _ in range(rng.randint(10, 400))] + ["zgarbage", "qvile"] * bad)
    sample = pa.table({"text": [make(i % 2) for i in range(600)], "label": [i % 2 for i in range(600)]})
    model = toxicity.fit(sample)
    flat, at = code_points(pa.array([make(i % 2) for i in range(200)]))
    assert (model.score(flat, at) >= 0.7).tolist() == [bool(i % 2) for i in range(200)]


def test_quality_query(spark):
    rows = registered.op10_quality(spark, DATA).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = accuracy(spark, rows, "quality", 5, 0)
    assert sum(p == y for p, y in held) > 0.9 * len(held) and sum(not p for p, y in held if y) <= 0.03 * len(held)


def test_neighbours_are_those_of_brute_force():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc \n") for _ in range(rng.randint(5, 300))) for _ in range(60)]
    model = quality.fit(pa.table({"text": texts, "label": [i % 2 for i in range(60)]}), dim=8, neighbours=5)
    flat, at = flat_bytes(pa.array(texts[:20]))
    latent = model.latent(flat, at)
    for row, got in zip(latent, model.score(flat, at), strict=True):
        near = sorted(((float(row @ v), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[:5]
        want = sum(max(c, 1e-6) ** 4 * y for c, y in near) / sum(max(c, 1e-6) ** 4 for c, _ in near)
        assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_rows(spark, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)] + [(3, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    run = toxicity.toxicity if module is toxicity else quality.quality
    rows = run(odd_rows(spark), labels).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1
    assert run(odd_rows(spark).where("false"), labels).count() == 0
    assert run(odd_rows(spark), labels.where("false")).count() == len(ODD) + 1


def test_no_language_is_left_out_of_training(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(70):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 40)), f"l{k:02}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.trained(df)
    assert model.languages == tuple(f"l{k:02}" for k in range(70)) and model.layer is not None
    out = language.identify(df, model).select("lang", "lang_pred").collect()
    assert len({r["lang"] for r in out if r["lang"] == r["lang_pred"]}) > 64  # nine rows of each are few to learn from
    small = learning.within(learning.labelled_sample(df, "lang", 1500, most_bytes=14_000).toArrow(), 14_000)  # a share is less than a text
    assert set(small.column("label").to_pylist()) == set(model.languages) and all(len(t) <= 200 for t in small.column("text").to_pylist())
