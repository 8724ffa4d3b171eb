"""Character n-gram counts of a whole corpus in hashed tables of fixed size.

The tables are counted over all rows, map-side first; a table has 2 ** bits numbers whatever the corpus, so it may be
sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.arrow_text import code_points, pieces

_PRIMES = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]
_INTS = [int(x) for x in _PRIMES]
SHIFT = 0x2F0B4C47


def gram_keys(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each code point (those at the end run into what follows)."""
    p = points.astype(np.uint32)
    n = len(p)
    key = np.full(n, order * SHIFT & 0xFFFFFFFF, dtype=np.uint32)
    for i in range(order):
        key[: n - i] += p[i:] * _PRIMES[i]
        key ^= key >> np.uint32(15)
        key *= _PRIMES[(i + 1) % 5]
    key ^= key >> np.uint32(16)
    return (key >> np.uint32(32 - bits)).astype(np.int64)


def separated(column: pa.Array, mark: int = 0x0A) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows with a mark before and after each, and the n + 1 offsets of the marks."""
    points, offsets = code_points(column)
    n = len(offsets) - 1
    out = np.full(len(points) + n + 1, mark, dtype=np.uint32)
    at = np.arange(len(points)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out[at] = points
    return out, offsets + np.arange(n + 1)


def gram_key(chars: tuple[int, ...], bits: int) -> int:
    """Bucket of one n-gram, the same as gram_keys gives."""
    key = len(chars) * SHIFT & 0xFFFFFFFF
    for i, c in enumerate(chars):
        key = (key + c * _INTS[i]) & 0xFFFFFFFF
        key ^= key >> 15
        key = key * _INTS[(i + 1) % 5] & 0xFFFFFFFF
    key ^= key >> 16
    return key >> (32 - bits)


def tables(values: DataFrame, orders: dict[int, int], prepare=None, mark: int = 0x0A, words=None) -> dict[int, np.ndarray]:
    """Counts by order; ``orders`` maps an order to its bits (16 for order 1 are the code points themselves).

    ``values`` has text columns only; ``prepare`` may change the code points before they are counted.  Order 0 counts
    words: ``words`` gives their buckets, of code points and bits.
    """
    shifts = {}
    base = 0
    for order, bits in orders.items():
        shifts[order] = base
        base += 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {order: np.zeros(1 << bits, dtype=np.int64) for order, bits in orders.items()}
        for batch in batches:
            for part in pieces(batch, *range(batch.num_columns)):
                for column in part.columns:
                    points, _ = separated(column, mark)
                    if prepare is not None:
                        points = prepare(points)
                    for order, bits in orders.items():
                        keys = words(points, bits) if order == 0 else np.minimum(points, 0xFFFF).astype(np.int64) if order == 1 else gram_keys(points, order, bits)
                        total[order] += np.bincount(keys[: max(len(keys) - max(order, 1) + 1, 0)], minlength=1 << bits)
        for order, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array((at + shifts[order]).astype(np.int32)), pa.array(counts[at])], names=["k", "n"])

    rows = values.mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(base, dtype=np.float32)
    out[np.asarray(rows.column("k"))] = np.asarray(rows.column("n"))
    return {order: out[shifts[order] : shifts[order] + (1 << bits)] for order, bits in orders.items()}
