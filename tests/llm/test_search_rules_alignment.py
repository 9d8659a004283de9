"""Quality rules, alignment of tokenizers and ranked search, each against a plain version."""

import hashlib
import math
import re
import tempfile
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import alignment, queries, rules, search

DATA = "/root/testdata/sf0.001"
A, RANKS, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
ODD = [None, "", " ", "\n", "a", "a b c d e f a b c d e g", "x " * 4000, "é \x0b ß|#\n é\n\n é", "1 2 3 4 5 6 7 8 9 10 11", "q w e r t " * 3 + "z", "a\x00b\x1c c", "　wide space", "😀 emoji"]


def documents(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()})


# Quality rules ---------------------------------------------------------------------------------------------------


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_statistics_equal_a_plain_count(spark):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in rules.BASE) for r in rules.statistics(documents(spark, texts), ["doc_id"]).collect()}
    assert got == {i: plain_statistics(t) for i, t in enumerate(texts)}


def test_long_text_has_its_statistics_in_one_row(spark):
    text = " ".join(f"w{i}" for i in range(300_000)) + " " + "again and again and again " * 20_000
    got = rules.statistics(documents(spark, [text]), ["doc_id"]).first()
    assert (got["n_words"], got["n_repeat_words"]) == (400_000, 100_000)


def labelled(spark, rows):
    """rows of (doc_id, bad, {statistic: level}); others are 0."""
    names = list(rules.STATISTICS)
    return spark.createDataFrame([(i, bad, *[found.get(n, 0) for n in names]) for i, bad, found in rows], "doc_id long, bad boolean, " + ", ".join(f"{n} int" for n in names))


def test_covering_finds_both_kinds_and_their_conjunction(spark):
    rows = []
    for i in range(1200):
        kind = i % 4
        found = {"symbols": 5 + i % 7, "upper": 20 + i % 9, "digits": i % 50}
        if kind == 0:
            found["symbols"] = 200 + i % 100  # bad by itself
        elif kind == 1:
            found |= {"upper": 300 + i % 90, "digits": 400 + i % 90}  # bad together
        elif kind == 2:
            found["upper" if i % 8 == 2 else "digits"] = 350 + i % 90  # good alone
        rows.append((i, kind < 2, found))
    found = rules.learned(labelled(spark, rows))
    names = [{t.statistic for t in r.thresholds} for r in found]
    assert {"symbols"} in names and {"upper", "digits"} in names and all(r.lost == 0 and r.caught >= 5 for r in found)
    judged = labelled(spark, rows).withColumn("rule", rules.rule_number(found))
    assert judged.where((F.col("rule") > 0) != F.col("bad")).count() == 0
    assert judged.where(F.expr(f"rule != {rules.as_sql(found)}")).count() == 0


def test_pruning_drops_what_noise_added(spark):
    rows = [(i, i % 2 == 0, {"symbols": 100 + i % 40 if i % 2 == 0 else i % 40, "digits": (i * 7919) % 1000}) for i in range(900)]
    assert [str(r) for r in rules.learned(labelled(spark, rows))] == ["symbols >= 100"]


def test_rules_without_bad_or_good_rows_are_none(spark):
    assert rules.learned(labelled(spark, [(i, False, {"symbols": i}) for i in range(30)])) == []
    assert rules.learned(labelled(spark, [(i, True, {"symbols": i}) for i in range(30)])) == []
    assert rules.learned(labelled(spark, [(None, True, {}), (1, None, {})]).limit(2)) == []


def test_rules_do_not_depend_on_partitioning(spark):
    stats = rules.statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ["doc_id"])
    table = stats.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").withColumn("bad", F.col("quality") == 0).cache()
    assert len({tuple(map(str, rules.learned(table.repartition(n)))) for n in (1, 3, 7)}) == 1


def test_rules_of_odd_rows(spark):
    docs = documents(spark, ODD, n_words=7, kept="x", lang=None).unionByName(spark.createDataFrame([(None, "some text of no id"), (5, ODD[5]), (5, ODD[5])], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(5, 0), (5, 1), (None, 0), (6, None)], "doc_id long, quality int")
    got = rules.quality_rules(docs, labels).collect()
    assert len(got) == len(ODD) + 3 and [tuple(r)[:6] for r in got if r["doc_id"] == 5][0] == (5, *plain_statistics(ODD[5]))
    assert all(not r["kept"] for r in got if r["base_failed"]) and not [r for r in got if r["doc_id"] is None and r["held_out"]]
    assert rules.quality_rules(docs.limit(0), labels).count() == 0 and rules.quality_rules(docs, labels.limit(0)).where("not base_failed and not kept").count() == 0
    with pytest.raises(ValueError):
        rules.statistics(docs, ["doc_id", "n_words"])


def test_rules_query_by_native_plan_and_held_out_rows(spark):
    out = queries.op11_quality_rules(spark, "/root/testdata/sf0.01")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in out.collect() if r["held_out"] and r["doc_id"] in label and not r["base_failed"]]
    assert all(r["kept"] for r in rows if label[r["doc_id"]] == 1)  # no clean document goes
    assert sum(not r["kept"] for r in rows if label[r["doc_id"]] == 0) >= 0.7 * sum(label[r["doc_id"]] == 0 for r in rows)


# Alignment -------------------------------------------------------------------------------------------------------


def plain_alignment(texts):
    """The contract, from the libraries' own ids: a dict of cut ends on each side."""
    a_coder, b_coder = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_coder.encode_special_tokens = True
    a_bytes, b_bytes = alignment.byte_tokens(A), alignment.pieces(B)[1]
    per, total = [], Counter()
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a, b = (a_coder.encode(" " + text, add_special_tokens=False).ids, b_coder.encode(text)) if text else ([], [])
        if b"".join(b_bytes[i] for i in b) != whole or b"".join(a_bytes[i] for i in a) != whole:
            a, b = [], []
        ends = []
        for ids, sizes in ((a, a_bytes), (b, b_bytes)):
            at, found = 0, {}
            for k, i in enumerate(ids, 1):
                at += len(sizes[i])
                found[at] = k
            ends.append(found)
        groups, i, j, links = [], 0, 0, []
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0][end], ends[1][end]
            groups.append((a[i:p], b[j:q]))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        total.update(links)
        per.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    return per, total, best


def expected(texts):
    per, total, best = plain_alignment(texts)
    said = lambda g: ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
    return [(n, m, len(g), len(x), sum(total[p] == best[p[1]] for p in x), sum(total[p] for p in x), hashlib.sha256(said(g).encode()).hexdigest() if g else "") for n, m, g, x in per]


ALIGNED = ODD + ["▁ marks", "<0x41></s><s><|endoftext|>", "tie tie tie", "naïve  two  spaces\r\n\ttabs ", "مرحبا 中文 text"]


@pytest.mark.parametrize("most", [1 << 19, 40])
def test_alignment_equals_a_plain_version(spark, most):
    texts = ALIGNED + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.alignment_counts(documents(spark, texts, pairs=1, row="x"), A, RANKS, B, most_pairs=most).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts)


def test_overlaps_are_the_pairs_that_share_bytes():
    x = alignment.align(["an unbelievable tokenization"], A, RANKS, B)
    sizes = [alignment.byte_tokens(A)[x.a], alignment.pieces(B)[1][x.b]]
    owners = [[k for k, t in enumerate(s) for _ in t] for s in sizes]
    assert {tuple(p) for p in x.overlaps.tolist()} == set(zip(*owners, strict=True)) and len(x.overlaps) > len(x.cut_a)


def test_aligned_gives_both_tokenizations_and_cuts(spark):
    texts = ["hello world", None, "naïve text", "▁"]
    got = {r["doc_id"]: r for r in alignment.aligned(documents(spark, texts, cut_a="old", lang="en"), A, RANKS, B).collect()}
    per, _, _ = plain_alignment(texts)
    for i, (_, _, groups, _) in enumerate(per):
        r, found, p, q = got[i], [], 0, 0
        for c, d in zip(r["cut_a"], r["cut_b"], strict=True):
            found.append((r["a_ids"][p:c], r["b_ids"][q:d]))
            p, q = c, d
        assert found == groups and r["lang"] == "en"


def test_long_texts_are_cut_where_pieces_are(monkeypatch):
    text = "some words  with  double  spaces and é 中文\n next line " * 50 + "end "
    whole = alignment.piece_ids(B, [text])
    for limit in (1, 7, 40):
        monkeypatch.setattr(alignment, "LONG", limit)
        assert alignment.piece_ids(B, [text, "x "]) == [whole[0], alignment.pieces(B)[0].encode("x ")]


def test_alignment_of_an_empty_table_and_repeats(spark):
    docs = documents(spark, ["one two", "one two"])
    assert alignment.alignment_counts(docs.limit(0), A, RANKS, B).count() == 0
    same = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two")], "doc_id long, text string")
    got = sorted((tuple(r)[1:] for r in alignment.alignment_counts(same, A, RANKS, B).collect()), key=repr)
    assert got == sorted(expected(["one two"] * 3), key=repr)


def test_alignment_query(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_alignment(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert got == dict(zip([d["doc_id"] for d in docs], expected([d["text"] for d in docs]), strict=True))


# Search ----------------------------------------------------------------------------------------------------------


def plain_search(docs, items, top):
    terms = lambda t: re.findall(search.TERM, re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, size = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(x for _, c in held for x in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // max(1, size)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 20 * m)) for x in wanted if c[x])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **how):
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, search.search(d.withColumn("n", F.lit("clash")), q.withColumn("term", F.lit(1)), **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"window": 7}, {"top": 3, "window": 5}, {"pairs": 4}])
def test_search_equals_a_plain_version(spark, how):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, f"common word{i % 5} Größe x{i % 3}") for i in range(60)] + [(None, "common word1"), (101, "common word1"), (101, "common word1"), (-7, "WORD1 A")]
    items = [(1, "Common word1 common"), (2, "größe X1 a"), (2, "emoji 😀"), (3, None), (4, "nothing_here"), (None, "word2"), (5, "GRÖSSE größe")]
    assert searched(spark, docs, items, **how) == plain_search(docs, items, how.get("top", 50))


def test_search_of_one_repeated_id_and_ties(spark):
    docs = [(7, "same words")] * 90 + [(i, "same words") for i in range(20)]
    got = searched(spark, docs, [(1, "words"), (2, "same words")], window=8)
    assert got == plain_search(docs, [(1, "words"), (2, "same words")], 50)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == [] and searched(spark, [(1, None)], [(1, "a")]) == []


def test_terms_by_bytes_in_segments(monkeypatch):
    monkeypatch.setattr(search, "SEGMENT", 11)
    flat, at = search.flat_bytes(search.pa.array(["ab cd", "", "Ünï ab " * 9, "x" * 40 + " ab"]))
    total, row, term, times = search.counted(flat, at, search.Vocabulary.of(["ab", "cd", "x" * 40]))
    assert total.tolist() == [2, 0, 18, 2] and list(zip(row.tolist(), term.tolist(), times.tolist(), strict=True)) == [(0, 0, 1), (0, 1, 1), (2, 0, 9), (3, 0, 1), (3, 2, 1)]


def test_search_query_matches_its_sql(spark):
    con = duckdb.connect(tempfile.mktemp(suffix=".db"))
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    assert sorted(map(tuple, queries.op13_lexical_search(spark, DATA).collect())) == sorted(con.sql(search.SEARCH_SQL).fetchall())
