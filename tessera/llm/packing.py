"""Packing documents into sequences of a fixed number of tokens.

Pieces of equal length are interchangeable, so the search works on the counts of lengths: a table of at most
``capacity`` rows at any input size. A start by next fit leaves room in nearly every bin; the local search then exchanges
one document for one, two for one or one for two, or moves one, between underfull bins, always raising the sum of
squared fills, until no exchange helps or no bin is left to empty. Whole groups of equal bins change at once, so the
work depends on the variety of bins and not on their number. What stays underfull is then mixed anew with some full
bins and searched again. Spark ranks the pieces of each length and looks up their places.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.bpe import encoding, ids_of
from tessera.llm.common import chunks, in_batches, ranked, unused, written

#: Characters about which versions of Unicode, and so the two libraries' patterns, could differ.
RARE = regex.compile(r"[^\u0000-ӿ]")

#: Pieces that next fit packs at once; equal templates stand for more.
TEMPLATE = 20480
#: Underfull bins that an attempt to save some takes apart, and how many full ones it takes at least.
MIXED = 128
#: The fill of no bin.
NONE = 1 << 60

Bins = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many in a bin), ...), number of such bins


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str) -> Tokenizer:
    found = Tokenizer.from_file(vocabulary)
    found.encode_special_tokens = True  # their strings are text like any other
    return found


def token_ids(text: str, vocabulary: str, ranks: str | None) -> np.ndarray:
    """The ids that the tokenizers library gives, without special tokens.

    The merges of a byte-level BPE are fixed by its ranks, so the same vocabulary as a rank file gives the same ids
    (tests compare them); texts with rare characters, or all if there is no rank file, go through the library itself.
    """
    if ranks is None or (not text.isascii() and RARE.search(text)):
        return np.array(tokenizer(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)
    return ids_of(encoding(ranks), text)


def tokenized_pieces(documents: DataFrame, vocabulary: str, ranks: str | None, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the id end, cut into pieces of capacity.

    Only documents longer than capacity are cut; the first piece may be shorter than the others. Null and empty
    texts are the end id alone. Repeated rows are documents of their own.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(token_ids(text or "", vocabulary, ranks).astype("<u4"), np.uint32(end))
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return in_batches(documents.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def next_fit(counts: dict[int, int], capacity: int, size: int = TEMPLATE, seed: int = 20240517) -> list[Bins]:
    """The start of the search: next fit over the pieces in mixed order, which leaves room in nearly every bin.

    Counts are divided by ``times``: a template of about ``size`` pieces is packed once and stands for ``times`` equal
    ones, and what the division leaves is packed likewise, an eighth or less each round. So the number of groups
    does not grow with the number of pieces but for the rounds, its logarithm.
    """
    left, bins, rng = dict(counts), [], np.random.default_rng(seed)
    size = max(size, 8 * len(counts))
    while left:
        times = max(1, sum(left.values()) // size)
        part = {x: n // times for x, n in sorted(left.items()) if n >= times}
        left = {x: n % times for x, n in left.items() if n % times}
        items, room = Counter(), capacity
        for x in rng.permutation(np.repeat(list(part), list(part.values()))).tolist():
            if x > room:
                bins.append((tuple(sorted(items.items())), times))
                items, room = Counter(), capacity
            items[x] += 1
            room -= x
        bins.append((tuple(sorted(items.items())), times))
    return bins


class LocalSearch:
    """Exchanges between underfull bins, each of which raises the sum of squared fills.

    A bin gets one document or two from a bin that is no fuller and returns none, one or (for one) two, so that its fill
    rises as far as the other bins allow; the giver may be left empty. For every length, and for every sum of two
    lengths of one bin, the emptiest bin that has it is indexed, so the best exchange among all pairs of bins is
    looked up and not searched. Equal bins are one group and change together. It ends when no pair of bins has an
    exchange left, or at the least possible number of bins. ``applied`` counts the exchanges of groups.
    """

    def __init__(self, bins: list[Bins], capacity: int):
        self.capacity, self.applied = capacity, 0
        self.number: Counter = Counter()
        for items, n in bins:
            self.number[tuple(sorted(items))] += n
        self.bins = sum(self.number.values())
        self.least = -(-sum(n * self.fill(g) for g, n in self.number.items()) // capacity)
        self.pairs = False
        self._index()

    @staticmethod
    def fill(group: tuple[tuple[int, int], ...]) -> int:
        return sum(x * k for x, k in group)

    def _index(self) -> None:
        self.low = np.full((2, self.capacity + 1), NONE)  # fill of the emptiest bin with a length, and with a sum of two
        self.heaps: list[dict[int, list]] = [{}, {}]
        for group in self.number:
            self._add(group)

    def _sums(self, group) -> tuple[set[int], set[int]]:
        one = {x for x, _ in group}
        two = {x + y for x in one for y in one if x < y} | {2 * x for x, k in group if k > 1} if self.pairs else set()
        return one, two

    def _add(self, group) -> None:
        fill = self.fill(group)
        if fill < self.capacity:
            for low, heaps, sums in zip(self.low, self.heaps, self._sums(group), strict=True):
                for s in sums:
                    heappush(heaps.setdefault(s, []), (fill, group))
                    if fill < low[s]:
                        low[s] = fill

    def _drop(self, group) -> None:
        """After the group left ``number``: entries at the top of a heap that are of no group go."""
        fill = self.fill(group)
        for low, heaps, sums in zip(self.low, self.heaps, self._sums(group), strict=True):
            for s in sums:
                if low[s] == fill and (heap := heaps.get(s)):
                    while heap and not self.number.get(heap[0][1]):
                        heappop(heap)
                    low[s] = heap[0][0] if heap else NONE

    def _change(self, group, n: int) -> None:
        before = self.number[group]
        self.number[group] += n
        if not before:
            self._add(group)
        elif not self.number[group]:
            del self.number[group]
            self._drop(group)

    def best(self, group) -> tuple[tuple, tuple[int, ...], tuple[int, ...]] | None:
        """The group that gives, what it gives and what it gets; None if the fill of ``group`` can't rise."""
        fill, lengths = self.fill(group), [x for x, _ in group]
        room = self.capacity - fill
        back = [(), *((x,) for x in lengths)]
        two = [(x, y) for i, x in enumerate(lengths) for y in lengths[i + 1 :]] + [(x, x) for x, k in group if k > 1]
        for low, heaps, returns in zip(self.low, self.heaps, (back + two, back), strict=True):
            sums = np.array([sum(r) for r in returns])
            last = np.maximum.accumulate(np.where(low <= fill, np.arange(len(low)), 0))
            rise = last[np.minimum(sums + room, self.capacity)] - sums
            at = int(rise.argmax())
            if rise[at] > 0:
                given = int(sums[at] + rise[at])
                donor = heaps[given][0][1]
                if heaps is self.heaps[0]:
                    return donor, (given,), returns[at]
                held = dict(donor)
                x = next(x for x in held if given - x in held and (2 * x != given or held[x] > 1))
                return donor, (x, given - x), returns[at]
        return None

    def improve(self, group) -> list[tuple]:
        """Applies the best exchange for the group, if there is one; the groups that came of it."""
        n = self.number[group]
        if n == 1:  # a bin can't give to itself
            del self.number[group]
            self._drop(group)
        found = self.best(group)
        if n == 1:
            self.number[group] = 1
            self._add(group)
        if not found:
            return []
        donor, give, take = found
        k = n // 2 if donor == group else min(n, self.number[donor])
        a, b = Counter(dict(donor)), Counter(dict(group))
        a.subtract(give)
        a.update(take)
        b.subtract(take)
        b.update(give)
        after = [tuple(sorted((+x).items())) for x in (b, a)]
        for g, m in ((group, -k), (donor, -k), (after[0], k), (after[1], k)):
            if g:
                self._change(g, m)
            else:
                self.bins -= m
        self.applied += 1
        return [g for g in (*after, group) if self.number.get(g) and self.fill(g) < self.capacity]

    def run(self) -> list[Bins]:
        """First with single documents alone; the larger index of sums of two is made of what that leaves."""
        for self.pairs in (False, True):
            self._index()
            changed = True
            while changed and self.bins > self.least:
                changed = False
                todo = [(-self.fill(g), g) for g in self.number if self.fill(g) < self.capacity]
                heapify(todo)
                while todo and self.bins > self.least:
                    _, group = heappop(todo)
                    if self.number.get(group):
                        for g in self.improve(group):
                            changed = True
                            heappush(todo, (-self.fill(g), g))
        return sorted(self.number.items(), key=lambda x: (-x[1], x[0]))


def local_search(bins: list[Bins], capacity: int, kicks: int = 8) -> list[Bins]:
    """Bins that no exchange fills further, after up to ``kicks`` attempts to save more of them.

    Each attempt takes the emptiest bins and a few times as many others apart, packs them by next fit in another order
    and searches again; it counts if that takes no more bins. It stops at the least possible number.
    """
    search = LocalSearch(bins, capacity)
    best, total, least = search.run(), search.bins, search.least
    rng = np.random.default_rng(20240518)
    for kick in range(kicks):
        if total <= least:
            break
        loose = sorted((x for x in best if LocalSearch.fill(x[0]) < capacity), key=lambda x: LocalSearch.fill(x[0]))
        full = [x for x in best if LocalSearch.fill(x[0]) == capacity]
        mixed: Counter = Counter()
        for some, want in ((loose, MIXED), ([full[i] for i in rng.permutation(len(full))], MIXED * (1 + kick % 4))):
            for group, n in some:
                mixed[group] = min(n, want)
                want -= mixed[group]
                if not want:
                    break
        counts: Counter = Counter()
        for items, n in mixed.items():
            for x, k in items:
                counts[x] += k * n
        again = LocalSearch(next_fit(counts, capacity, seed=kick), capacity)
        found = again.run()
        before = sum(mixed.values())
        if again.bins <= before:
            left = Counter(dict(best))
            left.subtract(mixed)
            left.update(dict(found))
            best, total = sorted((+left).items(), key=lambda x: (-x[1], x[0])), total - before + again.bins
    return best


def places(bins: list[Bins]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first, stop, each, sequence, offset: ranks from first to stop of a length fill bins, each in a bin."""
    out, used, sequence = [], Counter(), 0
    for items, n in bins:
        offset = 0
        for length, each in items:
            out.append((length, used[length], used[length] + n * each, each, sequence, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    return out


def packed(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (with doc_id, piece, length) with sequence_id and offset; gapless places in each sequence.

    pieces is read twice, so it should be a written table. Empty input gives no rows. Other columns are kept, whatever
    their names; those named like the two results are replaced.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    rows = places(local_search(next_fit(counts, capacity), capacity))
    size, low, high, each, base, at, rank = unused(pieces, "_size", "_low", "_high", "_each", "_base", "_at", "_rank")
    where = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in (size, low, high, each, base, at)))
    tie = [F.col(x) for x in ("doc_id", "piece", "start", "ids_crc32") if x in pieces.columns]
    numbered = ranked(pieces, ["length"], tie, F.xxhash64(*tie), rank=rank)
    # Bounded by the variety of bins, which capacity bounds.
    joined = numbered.join(F.broadcast(where), (F.col("length") == F.col(size)) & (F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high)))
    nth = F.col(rank) - F.col(low)
    placed = {"sequence_id": (F.col(base) + F.floor(nth / F.col(each))).cast("long"), "offset": (F.col(at) + (nth % F.col(each)) * F.col("length")).cast("long")}
    return joined.withColumns(placed).drop(size, low, high, each, base, at, rank)


def pack_documents(documents: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's ids, in as few sequences as found.

    Null ids, null and empty texts, very long texts and repeated rows are packed like any other; columns other than
    doc_id and text play no part.
    """
    pieces = written(tokenized_pieces(documents, vocabulary, ranks, capacity, end), "pieces")
    return packed(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
