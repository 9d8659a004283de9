"""Alignment of two tokenizers over the same bytes, by byte-owner arrays.

A is a byte-level BPE, read from its rank file and encoding a space before each text; B is a sentencepiece model, which
adds that space itself. The index of the token that owns each byte is written out for A and for B. Where the pair of
owners changes, an overlap of two tokens ends; where both change at once, both tokenizers cut, and the two tokens that
end there are linked. How often a pair of ids is linked is counted over the whole corpus and joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, in_batches, list_column, written
from tessera.llm.packing import token_ids

#: Bytes of text that are aligned at once; and characters of a text that sentencepiece sees at once, about.
SLICE, LONG = 1 << 19, 1 << 16
#: Counted pairs of ids that are broadcast at most, the most frequent first; others are joined by a shuffle.
MOST_PAIRS = 1 << 19
#: Before such a space no piece can end inside: only pieces of white space alone hold a space behind their first character.
SAFE = regex.compile(r"(?<=[^\s▁])(?= [\s\S])")
PAIR = 1 << 32


@lru_cache(maxsize=2)
def byte_tokens(vocabulary: str) -> np.ndarray:
    """The bytes of each id of a byte-level BPE in the tokenizers library's format, as an object array."""
    from tokenizers import Tokenizer

    entries = Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    found = np.full(max(entries.values()) + 1, b"", object)
    for entry, number in entries.items():
        found[number] = bytes(letter[c] for c in entry) if all(c in letter for c in entry) else entry.encode()
    return found


@lru_cache(maxsize=2)
def pieces(model: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray, bool]:
    """A sentencepiece model, the bytes of each id, and whether its texts may be cut at SAFE."""
    coder = sentencepiece.SentencePieceProcessor(model_file=model)
    found = np.full(coder.vocab_size(), b"", object)
    inner = False
    for i in range(len(found)):
        piece = coder.id_to_piece(i)
        found[i] = bytes([int(piece[3:5], 16)]) if coder.is_byte(i) else piece.replace("▁", " ").encode()
        inner |= bool(regex.search(r"[^▁]▁", piece))
    return coder, found, not inner


def piece_ids(model: str, texts: list[str]) -> list[list[int]]:
    """The ids of each text. Long ones are cut before spaces: the space that begins a piece is the one that B adds."""
    coder, _, cuts = pieces(model)
    if not cuts or max(map(len, texts), default=0) <= LONG:
        return coder.encode(texts, num_threads=1)
    found = []
    for text in texts:
        ids, start = [], 0
        while len(text) - start > LONG and (at := SAFE.search(text, start + LONG)):
            ids += coder.encode(text[start : at.start()])
            start = at.start() + 1
        found.append(ids + coder.encode(text[start:]))
    return found


@dataclass
class Alignment:
    """Many texts, one after another: flat ids of A and B, the places where texts begin among them (n + 1), for each cut
    the last A and B token before it, and the places where texts begin among the cuts. overlaps: rows (A, B) of tokens that share bytes."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    cut_at: np.ndarray
    overlaps: np.ndarray


def _starts(values: list) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int64)


def align(texts: list[str | None], vocabulary: str, ranks: str | None, model: str) -> Alignment:
    """The alignment of texts; those that are null or empty, or whose tokens do not give back their bytes, have no tokens."""
    a_bytes, b_bytes = byte_tokens(vocabulary), pieces(model)[1]
    a = [token_ids(" " + t, vocabulary, ranks) if t else () for t in texts]
    b = [x if t else () for t, x in zip(texts, piece_ids(model, [t or "" for t in texts]), strict=True)]
    for i, t in enumerate(texts):
        if t:
            whole = b" " + t.encode()
            if b"".join(b_bytes[b[i]]) != whole or b"".join(a_bytes[a[i]]) != whole:
                a[i] = b[i] = ()
    flat_a, flat_b = (np.concatenate([np.array(x, np.int64) for x in ids] or [np.zeros(0, np.int64)]) for ids in (a, b))
    a_at, b_at = _starts(a), _starts(b)
    a_size, b_size = _sizes(vocabulary, model)
    owner_a = np.repeat(np.arange(len(flat_a), dtype=np.int32), a_size[flat_a])
    owner_b = np.repeat(np.arange(len(flat_b), dtype=np.int32), b_size[flat_b])
    ends_a, ends_b = (np.append(x[1:] != x[:-1], True) if len(x) else np.zeros(0, bool) for x in (owner_a, owner_b))
    over, cut = np.flatnonzero(ends_a | ends_b), np.flatnonzero(ends_a & ends_b)
    cut_a, cut_b = owner_a[cut], owner_b[cut]
    return Alignment(flat_a, flat_b, a_at, b_at, cut_a, cut_b, np.searchsorted(cut_a, a_at), np.stack([owner_a[over], owner_b[over]], 1))


@lru_cache(maxsize=2)
def _sizes(vocabulary: str, model: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in found], np.int64) for found in (byte_tokens(vocabulary), pieces(model)[1]))


@lru_cache(maxsize=2)
def _words(a: int, b: int) -> np.ndarray:
    """Decimal ids with what follows them: of A within a group, of A at its end, of B within, of B at its end."""
    return np.array([f"{i}{end}".encode() for n, end in ((a, ","), (a, "|"), (b, ","), (b, ";")) for i in range(n)], object)


def group_digests(found: Alignment, sizes: tuple[int, int]) -> list[str]:
    """sha256 of each text's groups as text ("a1,a2|b1;a3|b2,b3"); empty without tokens."""
    words, (wide_a, wide_b) = _words(*sizes), sizes
    last_a, last_b = np.zeros(len(found.a), bool), np.zeros(len(found.b), bool)
    last_a[found.cut_a] = last_b[found.cut_b] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    code = np.concatenate([found.a + wide_a * last_a, 2 * wide_a + found.b + wide_b * last_b])[order]
    at = found.a_at + found.b_at
    return [hashlib.sha256(b"".join(words[code[i:j]])[:-1]).hexdigest() if j > i else "" for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def aligned(df: DataFrame, vocabulary: str, ranks: str | None, model: str, text: str = "text") -> DataFrame:
    """df without its text, with a_ids, b_ids, cut_a, cut_b (array of int): both tokenizations, and how many tokens of A
    and of B stand before each cut, so that group i is a_ids[cut_a[i - 1] : cut_a[i]] beside b_ids[cut_b[i - 1] : cut_b[i]].

    Null and empty texts, and those whose tokens do not give back a space and the text, have empty arrays. Columns named
    like a result are replaced. Rows are independent: nothing is shuffled.
    """
    names = ["a_ids", "b_ids", "cut_a", "cut_b"]
    kept = [f for f in df.schema.fields if f.name not in (text, *names)]
    plain = df.select(*[f"`{f.name}`" for f in kept], f"`{text}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, SLICE):
                x = align(part.column(text).to_pylist(), vocabulary, ranks, model)
                first = np.diff(x.cut_at)
                cut_a, cut_b = x.cut_a + 1 - np.repeat(x.a_at[:-1], first), x.cut_b + 1 - np.repeat(x.b_at[:-1], first)
                lists = [list_column(v, at, pa.int32()) for v, at in ((x.a, x.a_at), (x.b, x.b_at), (cut_a, x.cut_at), (cut_b, x.cut_at))]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + lists, names=[f.name for f in kept] + names)

    return in_batches(plain, run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + ", ".join(f"{x} array<int>" for x in names))


def summaries(documents: DataFrame, vocabulary: str, ranks: str | None, model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of each text, and its distinct linked pairs (A id * PAIR + B id) with their numbers."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = len(byte_tokens(vocabulary)), len(pieces(model)[1])
        for batch in batches:
            for part in chunks(batch, "text", SLICE):
                x = align(part.column("text").to_pylist(), vocabulary, ranks, model)
                pair, times, at = _distinct_pairs(x.a[x.cut_a] * PAIR + x.b[x.cut_b], x.cut_at)
                links = pa.array(np.diff(x.cut_at), pa.int64())
                columns = [part.column("doc_id"), pa.array(np.diff(x.a_at), pa.int64()), pa.array(np.diff(x.b_at), pa.int64()), links, links]
                columns += [pa.array(group_digests(x, sizes), pa.string()), list_column(pair, at, pa.int64()), list_column(times, at, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return in_batches(documents.select("doc_id", "text"), run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def _distinct_pairs(pairs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct pairs, how often each occurs, and where texts begin among them."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((pairs, row))
    pairs, row = pairs[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (row[1:] != row[:-1])])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.diff(np.append(first, len(pairs))), np.searchsorted(row[first], np.arange(len(at)))


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, n, best of linked rows (pair, times): how often each pair is linked, and whether no pair of its B id is more often."""
    counts = linked.groupBy("pair").agg(F.sum("times").alias("n"))
    most = counts.groupBy((F.col("pair") % PAIR).alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", F.col("pair") % PAIR).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_counts(documents: DataFrame, vocabulary: str, ranks: str | None, model: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    n_best counts a document's links whose pair is, over the whole corpus, linked as often as any pair of its B id;
    count_sum adds each link's corpus-wide count. Texts without tokens (null, empty, or not given back by the tokens)
    have zeros and an empty digest. Repeated rows and rows of null doc_id are documents of their own; an empty table
    gives no rows; other columns play no part.

    Pairs are counted within a text, then within a task, then over the corpus. The ``most_pairs`` most frequent pairs are
    broadcast, so what a shuffle joins are pairs too rare to make a key hot.
    """
    texts = written(summaries(documents, vocabulary, ranks, model).withColumn("row", F.monotonically_increasing_id()), "aligned")
    linked = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = written(pair_counts(linked), "pairs")
    often, rest = counts, None
    if counts.count() > most_pairs:
        share = most_pairs / counts.count()
        floor = counts.approxQuantile("n", [1 - 0.5 * share], 0.2 * share)[0]  # 0.7 of most_pairs are above it, at most
        often, rest = counts.where(F.col("n") > floor), counts.where(F.col("n") <= floor)
    totals = [F.sum("times").alias("links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    found = linked.join(F.broadcast(often), "pair")
    if rest is not None:
        found = found.unionByName(linked.join(F.broadcast(often), "pair", "left_anti").join(rest, "pair"))
    per_row = found.groupBy("row").agg(*totals)
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return texts.drop("pairs", "times").join(per_row, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
