"""Encoding of whole texts by a public byte-level BPE vocabulary, and decoding.

Every text is cut into overlapping chunks. Each chunk is split into pre-tokens on its own, and neighbours are stitched where
their pre-token boundaries agree (they resynchronise at the first two boundaries in a row that both put at the same places
of the overlap). Merges never cross a pre-token, so the pieces between agreed boundaries are encoded alone and the ids are
those of the whole text. The chunks of a text are stitched in the task that holds its row, so nothing is shuffled and each
text is read once; rows are what runs in parallel. Decoding joins the raw bytes of the ids before it reads them as UTF-8.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.runtime import balanced, kept_on_worker

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk without its overlap, and of the overlap behind it.
CHUNK, OVERLAP = 1024, 128

_SPLIT = regex.compile(PATTERN)
_BLANK = regex.compile(r"[\s\x1c-\x1f]")


def load(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The encoder of a rank file; a text like a special token is ordinary text to it."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def boundaries(chunk: str) -> list[int]:
    """Where the pre-tokens of a chunk end."""
    return [m.end() for m in _SPLIT.finditer(chunk)]


def pieces(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[str]:
    """Parts of a text, in order, that end where pre-tokens of the whole text end.

    A chunk begins at an agreed boundary. It gives way to the next one, which begins at any character of its last overlap, at
    the first place where both end a pre-token twice in a row, and not with a blank, since a run of blanks is split by what
    follows it. The last pre-tokens of a chunk, which what follows may change, are not asked. Where an overlap holds no such
    place (an endless word or run of blanks) the chunk is made twice as long.
    """
    start, size = 0, chunk
    while start + size < len(text):
        stop = start + size
        left = boundaries(text[start:stop])
        sure = {start + e for e in left[:-2]}
        after = stop - overlap
        right = [after + e for e in boundaries(text[after : stop + overlap])]
        meet = next((a for a, b in zip(right, right[1:]) if a in sure and b in sure and not _BLANK.match(text[a - 1])), None)
        if meet is None:
            size *= 2
            continue
        yield text[start:meet]
        start, size = meet, chunk
    yield text[start:]


def encode_table(docs: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids): the token ids of each row's whole text, without special tokens.

    Null and empty texts have an empty list; each row of docs gives one row, and other columns are ignored. overlap must be
    less than chunk.
    """
    rows = balanced(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = kept_on_worker(("tokens", vocabulary, folder), lambda: load(vocabulary, folder)).encode_ordinary

        def ids(t) -> list[int]:
            return [i for piece in pieces(t, chunk, overlap) for i in encode(piece)] if isinstance(t, str) and t else []

        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "ids": [ids(t) for t in batch["text"]]})

    return rows.mapInPandas(run, "key bigint, ids array<int>")


def decode_table(encoded: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) of (key, ids): the raw bytes of all ids joined, then read as UTF-8; an empty list gives ''."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = kept_on_worker(("tokens", vocabulary, folder), lambda: load(vocabulary, folder))
        for batch in batches:
            texts = [known.decode_bytes(list(i)).decode("utf-8", "replace") for i in batch["ids"]]
            yield pd.DataFrame({"key": batch["key"], "text": texts})

    return encoded.select("key", "ids").mapInPandas(run, "key bigint, text string")
