"""Text columns of Arrow batches as flat numpy arrays: bytes, code points and their offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer single text is still worked on whole.
CHUNK_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, *columns: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in the given columns have about CHUNK_BYTES bytes, each row in one slice."""
    n = batch.num_rows
    if not n:
        return
    size = np.zeros(n, dtype=np.int64)
    for c in columns:
        size += np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0).cast(pa.int64()))
    part = np.cumsum(size) // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def flat_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts of a column in one bytes object and the n + 1 byte offsets; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data is not None and len(column) else b""
    return raw, offsets - offsets[0] if len(column) else np.zeros(1, dtype=np.int64)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of a column and the n + 1 offsets into them; nulls are empty."""
    raw, offsets = flat_bytes(column)
    points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lead = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    before = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(lead, out=before[1:])
    return points, before[offsets]


def row_numbers(offsets: np.ndarray) -> np.ndarray:
    """The row of each element between the offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; 0 for an empty one."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def hash_runs(points: np.ndarray, offsets: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the code points of each run between the offsets, as int64; runs must cover all points."""
    size = np.diff(offsets)
    place = np.arange(len(points), dtype=np.uint64) - np.repeat(offsets[:-1], size).astype(np.uint64)
    x = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x += (place + np.uint64(seed + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(x, out=total[1:])
    out = total[offsets[1:]] - total[offsets[:-1]]
    out ^= size.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)
