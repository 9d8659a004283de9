"""Byte-level BPE by tiktoken with a local rank file.

Long texts are cut where a match of the pattern is certain to begin, so that the regular expression and the merge
never see a run longer than needed and the ids are those of the whole text. Decoding is on raw bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame

from tessera.llm.common import chunks, in_batches, list_column

#: Texts of more characters than this are cut at safe boundaries before they are encoded.
LONG = 1 << 16
#: A match begins at white space that follows anything else: no alternative of the pattern spans that place,
#: as only runs of white space, or one leading space, hold white space.
SAFE = regex.compile(r"(?<=\S)(?=\s)")
#: Runs of white space that are matched here and not by the library, which gives up on runs of a million characters.
RUN = regex.compile(r"\s{16384,}+")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file; one for each Python worker. Executors read their own copy of the file."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int = LONG) -> Iterator[str]:
    """text in order, in pieces that begin where a match begins; about limit characters where the text allows it."""
    start = 0
    while len(text) - start > limit:
        found = SAFE.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def without_runs(text: str) -> Iterator[tuple[str, bool]]:
    """text in order, in pieces that begin where a match begins, and whether a piece is a single match.

    A long run of white space is one: all of it at the end of the text, before other text all but its last character.
    """
    start = 0
    for run in RUN.finditer(text):
        stop = run.end() - (run.end() < len(text))
        if run.start() > start:
            yield text[start : run.start()], False
        yield text[run.start() : stop], True
        start = stop
    if start < len(text):
        yield text[start:], False


def ids_of(coder: tiktoken.Encoding, text: str) -> np.ndarray:
    if len(text) <= LONG:
        return coder.encode_to_numpy(text, disallowed_special=())
    found = []
    for part, one_match in without_runs(text):
        if one_match:
            found.append(np.array(coder._encode_single_piece(part), np.uint32))
        else:
            found += [coder.encode_to_numpy(piece, disallowed_special=()) for piece in safe_pieces(part)]
    return np.concatenate(found)


def encode_decode(df: DataFrame, rank_file: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """df with the token ids of its text column (array of int) and the bytes that the ids decode to (binary).

    No special tokens: their strings are text like any other. Null and empty texts have no ids and decode to no
    bytes. The text column is dropped; other columns are kept, but for any named like the two results, which are
    replaced. Rows are independent of each other: nothing is shuffled and a lost task is done again alone.
    """
    kept = [f for f in df.schema.fields if f.name not in (text, ids, decoded)]
    plain = df.select(*[f"`{f.name}`" for f in kept], f"`{text}`")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"`{ids}` array<int>, `{decoded}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(rank_file)
        for batch in batches:
            for part in chunks(batch, text):
                found = [ids_of(coder, x or "") for x in part.column(text).to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
                flat = np.concatenate(found).astype(np.int32)
                back = [coder.decode_bytes(x) for x in found]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [list_column(flat, at, pa.int32()), pa.array(back, pa.binary())], names=[f.name for f in kept] + [ids, decoded])

    return in_batches(plain, run, schema)
