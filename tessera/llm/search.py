"""Ranked lexical search: a fixed set of queries against all documents, scored window by window.

Documents stand in the order of their ids, in windows of ``WINDOW``. In a window each term has a posting list of slots;
a query's lists are added into one array of scores that fits into a processor's cache, a bitset tells which slots were
touched, and those alone are harvested into the query's heap. Spark cuts the corpus into ranges of ids, one task each,
and merges what the heaps hold. Queries come in blocks of bounded size, and of documents only terms that a block asks for are kept.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, flat_bytes, in_batches, list_column, written
from tessera.llm.grams import LOWER, mixed
from tessera.llm.shingles import BYTE, STEP

#: Documents of a window: their scores are 256 KiB.
WINDOW = 1 << 15
#: Pairs of query and term in a block of queries, about; a query is never split.
PAIRS = 1 << 17
#: Bytes of text that are cut into terms at once.
SEGMENT = 1 << 20
#: A term is a longest run of digits, letters a to z and all characters from U+0080 on.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INSIDE = np.ones(256, bool)
INSIDE[:128] = [chr(b).isalnum() for b in range(128)]


def terms_of(text: Column) -> Column:
    """The terms of a text in order, with repeats, as Spark has them; for queries, which are short."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(f"({TERM})"), 1)


@dataclass
class Vocabulary:
    """The terms of a block of queries: term number i is bytes[at[i]:at[i + 1]]; keys are sorted hashes, of term order[k]."""

    bytes: np.ndarray
    at: np.ndarray
    keys: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, terms: list[str]) -> Vocabulary:
        flat, at = flat_bytes(pa.array(terms, pa.string()))
        start, stop, key = spans(flat, at)
        assert len(start) == len(terms)
        order = np.argsort(key, kind="stable")
        return cls(flat.copy(), at, key[order], order)

    def numbers(self, flat: np.ndarray, start: np.ndarray, stop: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are terms of the vocabulary, and their numbers: found by hash, then compared byte by byte."""
        if not len(self.keys) or not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == key)
        number, size = self.order[place[hit]], (stop - start)[hit]
        same = np.diff(self.at)[number] == size
        live, k = np.flatnonzero(same), 0
        while len(live):
            equal = LOWER[flat[start[hit[live]] + k]] == self.bytes[self.at[number[live]] + k]
            same[live[~equal]] = False
            k += 1
            live = live[equal & (size[live] > k)]
        return hit[same], number[same]


def spans(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of every term of the texts that begin at ``at``; A-Z are folded in the hash."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = INSIDE[flat]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    heads = at[:-1][np.diff(at) > 0]
    edge[heads] = inside[heads]
    start = np.flatnonzero(edge)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    number = np.cumsum(edge) - 1
    within = np.arange(len(flat)) - start[np.maximum(number, 0)]
    within[~inside] = 0
    power = np.full(int(within.max()) + 1, STEP, np.uint64)
    power[0] = 1
    value = BYTE[LOWER[flat]] * np.multiply.accumulate(power)[within]
    value[~inside] = 0
    size = np.bincount(number[inside], minlength=len(start))
    return start, start + size, mixed(np.add.reduceat(value, start))


def segments(flat: np.ndarray, at: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs of about limit bytes that end between terms, so that a very long text is never worked on at once."""
    start, n = 0, len(flat)
    while start < n:
        stop = start + limit
        while stop < n:
            gap = np.flatnonzero(~INSIDE[flat[stop : stop + limit]])
            if len(gap):
                stop += int(gap[0])
                break
            stop += limit
        stop = min(stop, n)
        yield start, stop
        start = stop


def counted(flat: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text the number of its terms; and row, term number and occurrences of terms of the vocabulary, in that order."""
    total = np.zeros(len(at) - 1, np.int64)
    key, times, wide = [], [], max(1, len(vocabulary.order))
    for a, b in segments(flat, at):
        inner = np.unique(np.concatenate([[0], np.clip(at, a, b) - a, [b - a]]))
        start, stop, hashed = spans(flat[a:b], inner)
        row = np.searchsorted(at, start + a, "right") - 1
        total += np.bincount(row, minlength=len(total))
        hit, number = vocabulary.numbers(flat[a:b], start, stop, hashed)
        k, n = np.unique(row[hit] * wide + number, return_counts=True)
        key.append(k)
        times.append(n)
    if not key:
        return total, *[np.zeros(0, np.int64)] * 3
    unique, where = np.unique(np.concatenate(key), return_inverse=True)
    occurs = np.bincount(where, weights=np.concatenate(times), minlength=len(unique)).astype(np.int64)
    return total, unique // wide, unique % wide, occurs


def forward(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n, terms, times of every document that holds a term: n counts all its terms, the arrays those of the vocabulary."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)  # a block of queries
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n, row, term, times = counted(*flat_bytes(part.column("text")), shared.value)
                at = np.searchsorted(row, np.arange(len(n) + 1))
                found = [part.column("doc_id"), pa.array(n, pa.int64()), list_column(term, at, pa.int32()), list_column(times, at, pa.int32())]
                yield pa.RecordBatch.from_arrays(found, names=["doc_id", "n", "terms", "times"]).filter(pa.array(n > 0))

    return in_batches(documents.select("doc_id", "text"), run, f"doc_id {kind}, n long, terms array<int>, times array<int>")


def weights(frequency: dict[int, int], documents: int, size: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of terms 0 to size - 1; those of no document have 0."""
    found = np.zeros(size, np.int64)
    for term, df in frequency.items():
        found[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return found


def window_scores(terms: np.ndarray, slots: np.ndarray, gains: np.ndarray, queries: list[np.ndarray], documents: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """query, slots touched (ascending) and their scores, in one window of so many documents.

    terms, slots, gains: the window's postings, by document; each query is an array of term numbers.
    """
    order = np.argsort(terms, kind="stable")
    terms, slots, gains = terms[order], slots[order], gains[order]
    byte, bit = slots >> 3, (1 << (slots & 7)).astype(np.uint8)
    scores, occupied = np.zeros(documents, np.int64), np.zeros(documents // 8 + 1, np.uint8)
    for q, wanted in enumerate(queries):
        first, last = np.searchsorted(terms, wanted), np.searchsorted(terms, wanted, "right")
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if a < b:
                scores[slots[a:b]] += gains[a:b]  # a term's slots are distinct
                np.bitwise_or.at(occupied, byte[a:b], bit[a:b])
        touched = np.flatnonzero(np.unpackbits(occupied, bitorder="little"))
        if len(touched):
            yield q, touched, scores[touched]
            scores[touched] = 0
            occupied[:] = 0


def harvested(heap: list, slots: np.ndarray, scores: np.ndarray, before: int, ids: list, top: int) -> None:
    """Puts the best of a window into a heap of (score, -place, id); places count documents, so earlier ones win ties."""
    good = scores > (heap[0][0] if len(heap) == top else 0)
    slots, scores = slots[good], scores[good]
    if len(scores) > top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        good = scores >= least
        slots, scores = slots[good], scores[good]
        best = np.lexsort((slots, -scores))[:top]
        slots, scores = slots[best], scores[best]
    for slot, score in zip(slots.tolist(), scores.tolist(), strict=True):
        entry = (score, -(before + slot), ids[slot])
        if len(heap) < top:
            heapq.heappush(heap, entry)
        elif entry[:2] > heap[0][:2]:
            heapq.heapreplace(heap, entry)


def search(documents: DataFrame, items: DataFrame, top: int = 50, window: int = WINDOW, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: of every item of ``items`` (item_id, text) the ``top`` best documents, by score then doc_id.

    A document's score is the sum over the item's distinct terms of w * ((10^9 tf) div (1000 tf + 20 m)), where w falls
    with the share of documents that hold the term and m grows with the document's length; scores of 0 are no results.
    All documents count for N, L and df and all are ranked. Rows of one item_id (null is one too) are one item with the
    terms of all its texts. Null and empty texts hold no terms. Repeated rows of documents are documents of their own
    and may stand beside each other; a null doc_id comes after all others of its score. An empty table on either side
    gives no rows. Very long texts are cut into terms in parts. Other columns play no part.
    """
    asked = written(items.select("item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct(), "asked")
    blocks = max(1, -(-asked.count() // pairs))
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        one = _searched(documents, part, items.schema["item_id"].dataType, top, window)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _searched(documents: DataFrame, asked: DataFrame, item_kind, top: int, window: int) -> DataFrame:
    """item_id, doc_id, score: what the heaps of all tasks hold for a block of items."""
    rows = asked.orderBy("term", "item_id").collect()  # bounded by ``pairs`` of search
    terms = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    of_item: dict = {}
    for r in rows:
        of_item.setdefault(r["item_id"], []).append(number[r["term"]])
    names, queries = list(of_item), [np.array(sorted(x)) for x in of_item.values()]
    spark, kind = documents.sparkSession, documents.schema["doc_id"].dataType.simpleString()
    index = written(forward(documents, Vocabulary.of(terms)).withColumn("row", F.monotonically_increasing_id()), "forward")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    frequency = {r["term"]: r["df"] for r in held.collect()}  # a row for each term of the block
    shared = spark.sparkContext.broadcast((names, queries, weights(frequency, n_docs, len(terms))))
    id_type, item_type = index.select("doc_id").limit(0).toArrow().schema.field(0).type, asked.select("item_id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, weight = shared.value
        heaps: list[list] = [[] for _ in names]
        before = 0
        for part in _windows(batches, window):
            n = part.column("n").to_numpy()
            term, at = _flat(part.column("terms"))
            tf, _ = _flat(part.column("times"))
            slot = np.repeat(np.arange(len(n)), np.diff(at))
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[slot]))
            ids = part.column("doc_id").to_pylist()
            for q, slots, scores in window_scores(term, slot, gain, queries, len(n)):
                harvested(heaps[q], slots, scores, before, ids, top)
            before += len(n)
        item = [names[q] for q, heap in enumerate(heaps) for _ in heap]
        flat = [x for heap in heaps for x in heap]
        yield pa.RecordBatch.from_arrays([pa.array(item, item_type), pa.array([x[2] for x in flat], id_type), pa.array([x[0] for x in flat], pa.int64())], names=["item_id", "doc_id", "score"])

    # The written row number tells rows of one id apart, so even an id with very many rows is dealt to several ranges.
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranges = index.where(F.size("terms") > 0).repartitionByRange(max(1, n_docs // window), *order).sortWithinPartitions(*order)
    return in_batches(ranges.drop("row"), run, f"item_id {item_kind.simpleString()}, doc_id {kind}, score long")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[at[0] : at[-1]].astype(np.int64), at - at[0]


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of size rows, the last one shorter."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, size - n)
            held.append(take)
            n += take.num_rows
            batch = batch.slice(take.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: DuckDB SQL with the rows of search over documents and benchmark.
SEARCH_SQL = rf"""
with d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) as term from documents),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) as term from benchmark),
n as (select doc_id, count(*) as n from d group by doc_id),
c as (select count(*)::bigint as docs, sum(n)::bigint as terms from n),
m as (select doc_id, 100 - 50 + ((50 * n * docs) // terms) as m from n, c),
f as (select doc_id, term, count(*) as tf from d where term in (select term from q) group by doc_id, term),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, c group by term, docs),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from q join f using (term) join w using (term) join m using (doc_id) group by item_id, doc_id)
select item_id, rank, doc_id, score from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank from s where score > 0) where rank <= 50
"""
