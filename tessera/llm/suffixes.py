"""Repeated passages by sparse suffix arrays over words.

A suffix is kept where the hash of its first ``gram`` words is the least of a window of ``window`` such hashes, so
the same passage keeps the same suffixes wherever it stands: a passage of ``least`` words has one among its first
``window`` words. Kept suffixes are sorted by their first ``key`` words. Where suffixes of equal key differ in their
neighbourhoods, every run of ``least`` words is listed with the one kept suffix that it always has, and compared with the
first occurrence (by doc_id and place) of an equal run. Equal runs, in the same or another document, are repeats; all but
the first occurrence are reported, overlapping runs as one span.

Suffixes whose whole neighbourhood (``least`` words to either side) is equal are one row in the comparisons, so copies
of documents cost no more than their sort. Words are runs of anything but white space, compared by 64-bit hashes
(runs by those of the key and of the whole run); white space between words plays no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, discard, flat_bytes, in_batches, joined_unevenly, unused, written
from tessera.llm.grams import mixed
from tessera.llm.jaccard import chosen
from tessera.llm.shingles import STEP, words

LEAST, GRAM, WINDOW = 50, 8, 18
#: A match of LEAST words has a kept suffix among its first WINDOW words, so so many are left of it.
KEY = LEAST - WINDOW
INVERSE = np.array([pow(int(STEP), -1, 1 << 64)], np.uint64)


def running(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of hashes times powers, and the inverse powers: what the hash of any run of words needs."""
    n = len(word) + 1
    power = np.full(n, STEP, np.uint64)
    back = np.repeat(INVERSE, n)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    total = np.zeros(n, np.uint64)
    np.cumsum(word * power[:-1], out=total[1:])
    return total, back


def run_hash(sums: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total, back = sums
    return mixed((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + width] for every i, by doubling; len(x) - width + 1 values."""
    size, out = 1, x
    while size * 2 <= width:
        out = pick(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def kept_suffixes(sums: tuple[np.ndarray, np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (among all words) of the kept suffixes that have KEY words, and the number of the text of each."""
    size = np.maximum(np.diff(first) - GRAM + 1, 0)
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = first[:-1][owner] + place
    if not len(at):
        return at, owner
    gram = run_hash(sums, at, at + GRAM) >> np.uint64(1)
    # Texts stand WINDOW apart, so that no window holds grams of two.
    spread = np.full(int(size.sum()) + (len(size) + 1) * WINDOW, np.iinfo(np.uint64).max, np.uint64)
    where = np.arange(len(at)) + (owner + 1) * WINDOW
    spread[where] = gram
    least = sliding(spread, WINDOW, np.minimum)
    best = sliding(np.concatenate([np.zeros(WINDOW - 1, np.uint64), least]), WINDOW, np.maximum)
    some = (best[where] == gram) & (at + KEY <= first[1:][owner])
    return at[some], owner[some]


def suffix_rows(docs: DataFrame) -> DataFrame:
    """key, around (hash of the neighbourhood), doc_id, place, left, right (words there, LEAST at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                word, first, _ = words(*flat_bytes(part.column("text")), lower=False)
                sums = running(word)
                at, owner = kept_suffixes(sums, first)
                lo, hi = np.maximum(at - LEAST, first[:-1][owner]), np.minimum(at + LEAST, first[1:][owner])
                around = mixed(run_hash(sums, lo, at) + (hi - lo).astype(np.uint64)) ^ run_hash(sums, at, hi)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run_hash(sums, at, at + KEY).astype(np.int64)), pa.array(around.astype(np.int64)), part.column("doc_id").take(pa.array(owner)), pa.array((at - first[:-1][owner]).astype(np.int32)), pa.array((at - lo).astype(np.int32)), pa.array((hi - at).astype(np.int32))],
                    names=["key", "around", "doc_id", "place", "left", "right"],
                )

    return in_batches(docs, run, "key long, around long, doc_id long, place int, left int, right int")


def runs_through(texts: DataFrame) -> DataFrame:
    """Of texts with places (array of key, around, place): key, around, doc_id, place, lead, run (hash) of every run of
    LEAST words whose kept suffix, ``lead`` words after its start, stands at one of the places.

    A run's kept suffix is the first of least hash among its first WINDOW grams, so it is the same wherever the run
    stands, and each run is listed once.
    """

    def found(part: pa.RecordBatch) -> pa.RecordBatch:
        word, first, _ = words(*flat_bytes(part.column("text")), lower=False)
        sums = running(word)
        each = part.column("places")
        owner = np.repeat(np.arange(part.num_rows), each.value_lengths().to_numpy())
        key, around, place = (x.to_numpy() for x in each.flatten().flatten())
        at = first[:-1][owner] + place
        # An id that recurs with another text brings places of that text: they are none of this one.
        own = np.flatnonzero(at + KEY <= first[1:][owner])
        own = own[run_hash(sums, at[own], at[own] + KEY).astype(np.int64) == key[own]]
        order = own[np.argsort(at[own], kind="stable")]
        begins = at[order]
        start = np.flatnonzero(np.repeat(first[1:], np.diff(first)) - np.arange(len(word)) >= LEAST)
        start = start[np.searchsorted(begins, start) < np.searchsorted(begins, start + WINDOW)]
        if not len(start):
            start = lead = np.zeros(0, np.int64)
        else:
            gram = run_hash(sums, np.arange(len(word) - GRAM + 1), np.arange(GRAM, len(word) + 1)) >> np.uint64(1)
            windows = np.lib.stride_tricks.sliding_window_view(gram, WINDOW)
            lead = np.concatenate([windows[start[i : i + (1 << 16)]].argmin(axis=1) for i in range(0, len(start), 1 << 16)])
        lo, hi = (np.searchsorted(begins, start + lead, side) for side in ("left", "right"))
        pick = np.repeat(np.arange(len(start)), hi - lo)
        row = order[np.arange(len(pick)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        start, lead = start[pick], lead[pick]
        columns = [pa.array(key[row]), pa.array(around[row]), part.column("doc_id").take(pa.array(owner[row])), pa.array(place[row].astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(run_hash(sums, start, start + LEAST).astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "around", "doc_id", "place", "lead", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                yield found(part)

    return in_batches(texts, run, "key long, around long, doc_id long, place int, lead int, run long")


def joined_spans(spans: DataFrame) -> DataFrame:
    """doc_id, start, stop, first_doc_id: overlapping or touching spans of a document as one, with the least first_doc_id.

    A document's spans are bounded by its length; they are joined in one pass over their order.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    numbered = spans.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_doc_id").alias("first_doc_id")).drop("run")


def with_heads(rows: DataFrame, most: int = 1 << 16, hot: int = 1000) -> DataFrame:
    """Suffix rows (a written table) whose key another row has, with head (the first row of equal key and around) and n (their number).

    The rows of a key are sorted and compared in one window. Keys of ``hot`` rows or more, the ``most`` most frequent of
    them, do not go through it: they are counted and their heads found before the shuffle, and their rows stay apart.
    """
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= hot)
    often = F.broadcast(written(counts.orderBy(F.desc("rows"), "key").limit(most).select("key"), "often"))
    by_key, same = Window.partitionBy("key"), Window.partitionBy("key", "around")
    where = F.struct("doc_id", "place")
    first = F.first(where).over(same.orderBy("doc_id", "place"))
    order = by_key.orderBy("around", "doc_id", "place")
    few = rows.join(often, "key", "left_anti").withColumns({"before": F.lag("doc_id").over(order), "after": F.lead("doc_id").over(order), "head": first, "n": F.count(F.lit(1)).over(same)})
    few = few.where("before is not null or after is not null").drop("before", "after")
    many = rows.join(often, "key")
    heads = many.groupBy("key", "around").agg(F.min(where).alias("head"), F.count(F.lit(1)).alias("n"))
    return few.unionByName(joined_unevenly(many, written(heads, "hot"), ["key", "around"], "n"))


def repeated_passages(documents: DataFrame) -> DataFrame:
    """doc_id, start, stop (words, from 0), n_words, first_doc_id: what repeats an earlier passage of LEAST words or more.

    Passages are earlier by doc_id, then place; the first occurrence is never reported. first_doc_id is the smallest
    of the documents that hold an earlier occurrence of a part of the span. Null and empty texts, texts of fewer words
    and rows of null doc_id have no spans; rows that repeat a doc_id count once. An empty table gives no rows.
    """
    docs = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, where = written(suffix_rows(docs), "suffixes"), F.struct("doc_id", "place")
    shared = written(with_heads(rows), "shared")
    discard(rows)
    heads = shared.where(where == F.col("head")).select("key", "around", "doc_id", "place", "n").distinct()
    differing = heads.groupBy("key").agg(F.count(F.lit(1)).alias("heads")).where("heads > 1")
    heads = written(joined_unevenly(heads, written(differing, "differing"), ["key"], "heads"), "heads")

    places = written(heads.groupBy("doc_id").agg(F.collect_list(F.struct("key", "around", "place")).alias("places")), "places")
    texts = chosen(docs, places.select("doc_id")).join(places, "doc_id")
    runs = written(runs_through(texts), "runs")
    first = runs.groupBy("key", "run").agg(F.min(where).alias("first"), F.max(where).alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last")
    later = joined_unevenly(runs, written(first, "first"), ["key", "run"], "n").where(where > F.col("first"))
    # Leads are less than LEAST apart, so a suffix's runs overlap and make one span.
    matches = later.groupBy("key", "around").agg(F.max("lead").alias("l"), (F.lit(LEAST) - F.min("lead")).alias("r"), F.min("first.doc_id").alias("earlier"))
    matches = matches.join(heads.select("key", "around", "n"), ["key", "around"])

    equal = shared.where((F.col("head") < where) & (F.col("left") + F.col("right") >= LEAST))
    spans = equal.select("doc_id", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("stop"), F.col("head.doc_id").alias("first_doc_id"))
    found = joined_unevenly(shared.drop("n"), written(matches, "matches"), ["key", "around"], "n")
    spans = spans.unionAll(found.select("doc_id", F.col("place") - F.col("l"), F.col("place") + F.col("r"), "earlier"))
    out = joined_spans(spans.distinct())
    return out.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "first_doc_id")


def without_repeats(documents: DataFrame) -> DataFrame:
    """documents with the repeats of passages cut from their texts, n_chars (if there) made to fit.

    What is cut goes from the first byte of a span to the first byte of the word after it. Documents of which no word
    is left go, unless they had none before; all other documents stay, and those without repeats are unchanged. Spans
    name a text by its doc_id alone, so rows whose doc_id another text also has stay whole. Null ids and texts stay.
    """
    spans = written(repeated_passages(documents), "spans")
    several = chosen(documents.select("doc_id", F.xxhash64("text").alias("_key")), spans.select("doc_id").distinct())
    several = several.groupBy("doc_id").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).where("a != b").select("doc_id")
    spans = spans.join(several, "doc_id", "left_anti")
    cuts = spans.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_cuts"))
    work = unused(documents, "_doc", "_cuts")
    cuts = cuts.toDF(*work)
    names, kinds = documents.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], batch.column("text").to_pylist()
            for i, cut in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                keep.append(True)
                if not cut:
                    continue
                data = texts[i].encode()
                _, first, start = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=False)
                ends = [*start.tolist(), len(data)]
                parts, at = [], 0
                for c in cut:
                    parts.append(data[at : ends[min(c["start"], len(start))]])
                    at = ends[min(c["stop"], len(start))]
                texts[i] = b"".join([*parts, data[at:]]).decode()
                keep[-1] = bool(texts[i].strip())
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            if "n_chars" in names:
                old = batch.column("n_chars").to_pylist()
                changed = [len(t) if c else o for t, c, o in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), old, strict=True)]
                columns[names.index("n_chars")] = pa.array(changed, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    joined = documents.join(cuts, documents["doc_id"] == cuts[work[0]], "left").select(*[documents[n] for n in names], cuts[work[1]])
    return in_batches(joined, run, kinds)
