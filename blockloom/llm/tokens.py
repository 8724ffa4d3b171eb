"""Encoding of a corpus with a public byte-level BPE tokenizer.

Pre-tokenisation is vectorised: an array of code-point classes and a transition on neighbouring classes locate all
boundaries of a batch without a regular expression.  As the state of that automaton is only the class of the character
before, its scan is a shift and a comparison, and contractions are a second, local transition.  The slices between
boundaries feed pair merging behind a cache; byte offsets of the slices are kept for decoding on request.

Defined results: null and empty texts give an empty list; special-looking strings are ordinary text; texts of any
length are encoded whole; repeated rows are encoded each; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.arrow_text import flat_bytes, pieces

TOKENIZERS = "/opt/tokenizers"
RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Slices kept by each Python worker.
CACHE_SIZE = 200_000
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Contractions of the tokenizer's pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space of the tokenizer's pattern.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    by_category = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((by_category.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


def boundaries(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bitmap of the code points that begin a slice."""
    n = len(points)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True  # a text begins here; at n the end of all
    if not n:
        return first[:0]
    kind = classes()[points]
    space = kind == SPACE
    changed = np.ones(n, dtype=bool)
    changed[1:] = kind[1:] != kind[:-1]
    changed |= first[:n]
    word_next = np.zeros(n, dtype=bool)  # a character other than white space follows in the same text
    word_next[:-1] = ~space[1:] & ~first[1:n]
    blank = points == 0x20
    attached = np.zeros(n, dtype=bool)  # the blank before belongs to this slice
    attached[1:] = blank[:-1] & ~first[1:n]
    start = np.where(space, changed | word_next, changed & ~attached)

    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        row_end = offsets[1:][np.searchsorted(offsets, quote, side="right") - 1]
        done = np.zeros(len(quote), dtype=bool)
        for word in CONTRACTIONS:
            fits = ~done & (quote + len(word) < row_end)
            for i, ch in enumerate(word):
                fits &= points[np.minimum(quote + 1 + i, n - 1)] == ord(ch)
            done |= fits
            at = quote[fits]
            start[at + 1] = False
            after = at + 1 + len(word)
            inside = after[after < row_end[fits]]
            start[inside[~space[inside]]] = True
    return start


def _merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Byte pair merging of one slice: always the leftmost pair of the lowest rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
    while pair:
        low = min(pair)
        if low == 1 << 30:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


class Encoder:
    """Ids of slices, kept in a cache."""

    def __init__(self, path: str):
        with open(os.path.join(path, RANKS_FILE), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.kept: dict[bytes, list[int]] = {}
        try:
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
            self.merge = own._encode_single_piece
        except (ImportError, AttributeError):
            self.merge = lambda piece: _merge(self.ranks, piece)

    def __missing__(self, piece: bytes) -> list[int]:
        ids = [self.ranks[piece]] if piece in self.ranks else list(self.merge(piece))
        if len(self.kept) >= CACHE_SIZE:
            self.kept.clear()
        self.kept[piece] = ids
        return ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, n + 1 offsets of the texts into them; byte ends of the slices, n + 1 offsets into those."""
        raw, byte_offsets = flat_bytes(column)
        data = np.frombuffer(raw, dtype=np.uint8)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        offsets = np.searchsorted(lead, byte_offsets)
        begin = np.flatnonzero(boundaries(points, offsets))
        edges = np.append(lead[begin], len(raw)) if len(begin) else np.zeros(1, dtype=np.int64)
        at = edges.tolist()
        kept, missing = self.kept, self.__missing__
        ids: list[int] = []
        counts = np.empty(len(begin), dtype=np.int64)
        for i, (a, b) in enumerate(zip(at, at[1:])):
            piece = raw[a:b]
            got = kept.get(piece) or missing(piece)
            ids += got
            counts[i] = len(got)
        slice_offsets = np.searchsorted(begin, offsets)
        total = np.zeros(len(begin) + 1, dtype=np.int64)
        np.cumsum(counts, out=total[1:])
        return np.array(ids, dtype=np.int32), total[slice_offsets], edges[1:], slice_offsets


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in pieces(batch, 1):
                ids, at, ends, ends_at = own.encode(part.column(1))
                columns = [part.column(0), pa.ListArray.from_arrays(at.astype(np.int32), ids)]
                names = ["doc_id", "ids"]
                if offsets:
                    begin = flat_bytes(part.column(1))[1][:-1]
                    ends = ends - np.repeat(begin, np.diff(ends_at))
                    columns.append(pa.ListArray.from_arrays(ends_at.astype(np.int32), ends.astype(np.int64)))
                    names.append("slice_ends")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(documents: DataFrame, tokenizers: str = TOKENIZERS, offsets: bool = False) -> DataFrame:
    """(doc_id, ids) of each row; with ``offsets`` also the byte end of each slice in the text.  No shuffle."""
    src = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, ids array<int>" + (", slice_ends array<long>" if offsets else "")
    return src.mapInArrow(_encode(tokenizers, offsets), schema)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in pieces(batch, 1):
                _, at, _, _ = own.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at))], names=["doc_id", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of each row; 0 for null and empty texts."""
    src = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(_count(tokenizers), "doc_id long, n_tokens long")


def decode_ids(encoded: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); a list that is cut within a character shows U+FFFD there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {v: k for k, v in encoder(tokenizers).ranks.items()}
        for batch in batches:
            texts = [None if x is None else b"".join(back[i] for i in x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
