"""Structural index of JSON text: vectorised over the bytes of many bodies at once.

Quote, bracket and delimiter bitmaps are made over one byte array, nesting depth comes from prefix sums, and each
container gets its parent, its key and its position in the parent from searches in per-depth position lists.  No
value is parsed until a span is asked for.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUOTE, BACKSLASH, COLON, COMMA = 0x22, 0x5C, 0x3A, 0x2C
_NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?$"
OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY = 0x7B, 0x7D, 0x5B, 0x5D


def unwrap(body: str | None) -> bytes | None:
    """UTF-8 bytes of a readable JSON body, string-encoded bodies unwrapped; None if it cannot be read.

    This is the exact check: a truncated or otherwise invalid body gives nothing.  A string within a string is
    shorter, so unwrapping ends however deep it goes.
    """
    while True:
        if body is None or not body.strip():
            return None
        try:
            value = json.loads(body)
        except ValueError:
            return None
        if not isinstance(value, str):
            return body.encode("utf-8", "surrogatepass") if isinstance(value, (dict, list)) else None
        body = value


def _escaped(buf: np.ndarray) -> np.ndarray:
    """Bitmap of bytes that follow an odd run of backslashes."""
    n = len(buf)
    out = np.zeros(n, dtype=bool)
    at = np.flatnonzero(buf == BACKSLASH)
    if not len(at):
        return out
    first = np.ones(len(at), dtype=bool)
    first[1:] = np.diff(at) != 1
    run = np.cumsum(first) - 1
    rank = np.arange(len(at)) - np.flatnonzero(first)[run]  # place in its run, from 0
    after = at[rank % 2 == 0] + 1  # the 1st, 3rd, ... backslash escapes the next byte
    out[after[after < n]] = True
    return out


class StructuralIndex:
    """Containers and string values of a batch of readable bodies.

    For each container (in order of its opening bracket): ``body`` number, ``start`` and ``end`` byte, ``depth``,
    ``parent`` container (-1 at the root), ``is_array``, ``key_start``/``key_len`` (key_len -1 if it isn't the
    value of a key), ``pos`` (place in a parent array, else -1).
    """

    def __init__(self, bodies: list[bytes]):
        self._solid = self._slashes = None
        sizes = np.array([len(b) for b in bodies], dtype=np.int64)
        ends = np.cumsum(sizes + 1)
        self.begin = ends - sizes - 1
        self.raw = b"\n".join(bodies) + b"\n"
        buf = self.buf = np.frombuffer(self.raw, dtype=np.uint8)

        quotes = np.flatnonzero((buf == QUOTE) & ~_escaped(buf))
        parity = np.zeros(len(buf) + 1, dtype=np.int8)
        np.add.at(parity, quotes + 1, 1)
        inside = np.cumsum(parity[:-1]) & 1  # bodies are readable, so each holds an even number of quotes
        outside = inside == 0
        is_open = outside & ((buf == OPEN_OBJECT) | (buf == OPEN_ARRAY))
        is_close = outside & ((buf == CLOSE_OBJECT) | (buf == CLOSE_ARRAY))
        is_comma = outside & (buf == COMMA)
        is_colon = outside & (buf == COLON)
        is_quote = np.zeros(len(buf), dtype=bool)
        is_quote[quotes] = True

        self.tok = np.flatnonzero(is_open | is_close | is_comma | is_colon | is_quote)  # the structural index
        kinds = buf[self.tok]
        depth = np.cumsum(is_open[self.tok].astype(np.int32) - is_close[self.tok].astype(np.int32))

        opens = np.flatnonzero(is_open[self.tok])
        closes = np.flatnonzero(is_close[self.tok])
        commas = np.flatnonzero(is_comma[self.tok])
        self.start = self.tok[opens]
        self.depth = depth[opens]
        self.is_array = buf[self.start] == OPEN_ARRAY
        self.body = np.searchsorted(self.begin, self.start, side="right") - 1
        n = len(opens)
        self.parent = np.full(n, -1, dtype=np.int64)
        self.end = np.zeros(n, dtype=np.int64)
        self.pos = np.full(n, -1, dtype=np.int64)
        close_depth, comma_depth = depth[closes] + 1, depth[commas]
        self._commas: dict[int, np.ndarray] = {}
        by_depth: dict[int, np.ndarray] = {}
        for d in range(1, int(self.depth.max(initial=0)) + 1):
            here = by_depth[d] = np.flatnonzero(self.depth == d)
            self.end[here] = self.tok[closes[close_depth == d]]
            self._commas[d] = self.tok[commas[comma_depth == d]]
            if d > 1:
                up = by_depth[d - 1]
                self.parent[here] = up[np.searchsorted(self.start[up], self.start[here]) - 1]
        own = np.flatnonzero(self.parent >= 0)
        for d in np.unique(self.depth[own]):
            here = own[self.depth[own] == d]
            up = self.parent[here]
            in_array = self.is_array[up]
            self.pos[here[in_array]] = self._count_commas(d - 1, self.start[up[in_array]], self.start[here[in_array]])

        self.key_start = np.zeros(n, dtype=np.int64)
        self.key_len = np.full(n, -1, dtype=np.int64)
        keyed = np.flatnonzero((opens >= 3) & (kinds[np.maximum(opens - 1, 0)] == COLON))
        self.key_start[keyed] = self.tok[opens[keyed] - 3] + 1
        self.key_len[keyed] = self.tok[opens[keyed] - 2] - self.key_start[keyed]
        self._opens = opens

        # members of objects: token numbers of each colon, with the container that holds it
        self._colons = np.flatnonzero(is_colon[self.tok])
        colon_at, colon_depth = self.tok[self._colons], depth[self._colons]
        self._colon_owner = np.full(len(self._colons), -1, dtype=np.int64)
        for d, here in by_depth.items():
            sel = np.flatnonzero(colon_depth == d)
            if len(sel):
                self._colon_owner[sel] = here[np.searchsorted(self.start[here], colon_at[sel]) - 1]

    def _count_commas(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        at = self._commas[int(depth)]
        return np.searchsorted(at, hi) - np.searchsorted(at, lo)

    def _spelled(self, start: np.ndarray, length: np.ndarray, word: str) -> np.ndarray:
        raw = word.encode()
        out = length == len(raw)
        at = np.flatnonzero(out)
        for i, b in enumerate(raw):
            at = at[self.buf[start[at] + i] == b]
        out[:] = False
        out[at] = True
        return out

    def keyed(self, word: str) -> np.ndarray:
        """Bitmap of the containers that are the value of key ``word``."""
        return self._spelled(self.key_start, self.key_len, word)

    def members(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner container and value span (start, end) of each member with key ``word``."""
        close = self.tok[self._colons - 1]
        start = self.tok[self._colons - 2] + 1
        hit = np.flatnonzero(self._spelled(start, close - start, word))
        owner = self._colon_owner[hit]
        lo = self.tok[self._colons[hit]] + 1
        hi = np.empty(len(hit), dtype=np.int64)
        for d in np.unique(self.depth[owner]) if len(owner) else []:
            sel = np.flatnonzero(self.depth[owner] == d)
            at = self._commas[int(d)]
            nxt = np.searchsorted(at, lo[sel])
            comma = np.where(nxt < len(at), at[np.minimum(nxt, max(len(at) - 1, 0))] if len(at) else 0, len(self.buf))
            hi[sel] = np.minimum(comma, self.end[owner[sel]])
        return owner, lo, hi

    def elements(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, position and span (start, end) of the elements of arrays; an empty array has none."""
        out: list[tuple[np.ndarray, ...]] = []
        for d in np.unique(self.depth[which]) if len(which) else []:
            own = which[self.depth[which] == d]
            at = self._commas[int(d)]
            first = np.searchsorted(at, self.start[own])
            count = np.searchsorted(at, self.end[own]) - first + 1
            owner = np.repeat(own, count)
            pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            comma = np.append(at, 0)
            k = np.repeat(first, count) + pos
            lo = np.where(pos == 0, self.start[owner], comma[np.minimum(np.maximum(k - 1, 0), len(at))]) + 1
            hi = np.where(pos == np.repeat(count, count) - 1, self.end[owner], comma[np.minimum(k, len(at))])
            lo, hi = self.trimmed(lo, hi)
            keep = lo < hi
            out.append((owner[keep], pos[keep], lo[keep], hi[keep]))
        if not out:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        owner, pos, lo, hi = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((pos, owner))
        return owner[order], pos[order], lo[order], hi[order]

    def trimmed(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans without white space at both ends; blank ones are empty."""
        if self._solid is None:
            self._solid = np.flatnonzero((self.buf != 0x20) & (self.buf != 0x0A) & (self.buf != 0x0D) & (self.buf != 0x09))
        solid = self._solid
        first, last = np.searchsorted(solid, lo), np.searchsorted(solid, hi) - 1
        some = first <= last
        return np.where(some, solid[np.minimum(first, len(solid) - 1)], lo), np.where(some, solid[np.maximum(last, 0)] + 1, lo)

    def raw_texts(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """The bytes of spans, as they stand."""
        size = hi - lo
        ends = np.cumsum(size)
        data = self.buf[np.repeat(lo - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        offsets = np.append(0, ends).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.large_string(), safe=False)

    def texts(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """Values of spans as strings: strings read, null and empty spans as null, anything else as its JSON text.

        Only strings with a backslash are read one by one.
        """
        lo, hi = self.trimmed(lo, hi)
        if not len(lo):
            return pa.array([], pa.string())
        quoted = (self.buf[lo] == QUOTE) & (hi > lo)
        own = self.raw_texts(lo + quoted, hi - quoted)
        null = pc.and_(pc.or_(pc.equal(own, "null"), pc.equal(own, "")), pa.array(~quoted))
        if self._slashes is None:
            self._slashes = np.append(0, np.cumsum(self.buf == BACKSLASH))
        at = np.flatnonzero(quoted & (self._slashes[hi] > self._slashes[lo]))
        if len(at):
            read = [json.loads(self.raw[a:b]).encode("utf-8", "replace").decode() for a, b in zip(lo[at].tolist(), hi[at].tolist())]
            mask = np.zeros(len(lo), dtype=bool)
            mask[at] = True
            own = pc.replace_with_mask(own, pa.array(mask), pa.array(read, pa.large_string()))
        return pc.if_else(null, pa.scalar(None, pa.large_string()), own).cast(pa.string())

    def numbers(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """Values of spans as doubles; null for what is no number."""
        lo, hi = self.trimmed(lo, hi)
        own = self.raw_texts(lo, hi)
        own = pc.if_else(pc.match_substring_regex(own, _NUMBER), own, pa.scalar(None, own.type))
        try:
            return own.cast(pa.float64())
        except pa.ArrowInvalid:  # out of range
            return pa.array([None if v is None else float(v) for v in own.to_pylist()], pa.float64())
