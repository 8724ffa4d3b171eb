"""Deeply nested manuals to flat, linked tables.

A body is one manual as JSON: ``meta`` (with ``tags`` and ``blog_links``) and ``pages`` of ``blocks`` with
``layout.segments`` and ``children``.  The shape of a field varies: a lone object may stand for an array, the manual may
be wrapped in other objects or arrays or be a JSON string itself.  The manual is the outermost object that has a
``meta`` or ``pages`` member.

Defined results: null, blank or unreadable bodies, and bodies without a manual, give no row; a null in an array takes
up its position and gives no row; other scalars in an array of objects take up their position and give no row; repeated
records give rows each; an empty table gives an empty table; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.structural import OPEN_ARRAY, OPEN_OBJECT, StructuralIndex, unwrap

POSITIONS = "raw_id long, kind string, page_pos long, block_pos long, item_pos long"
CHUNK_BYTES = 8 << 20
KINDS = ("page", "block", "segment", "child", "link", "tag")
#: Kinds of rows that only the tables have.
MORE_KINDS = ("manual", "vertex")
#: The related tables: kind of their rows, positions that link them to their parents, and their fields.
TABLES: dict[str, tuple[str, tuple[str, ...], dict[str, str]]] = {
    "manuals": ("manual", (), {"manual_name": "string", "source": "string", "source_lang": "string", "target_lang": "string"}),
    "tags": ("tag", ("item_pos",), {"tag": "string"}),
    "links": ("link", ("item_pos",), {"title": "string", "url": "string", "translated_url": "string"}),
    "pages": ("page", ("page_pos",), {"image": "string"}),
    "blocks": ("block", ("page_pos", "block_pos"), {"text": "string", "translation": "string", "bbox": "array<double>"}),
    "segments": ("segment", ("page_pos", "block_pos", "item_pos"), {"start": "long", "end": "long"}),
    "vertices": ("vertex", ("page_pos", "block_pos", "item_pos"), {"x": "double", "y": "double"}),
    "children": ("child", ("page_pos", "block_pos", "item_pos"), {"text": "string", "translation": "string"}),
}
BOX = ("x", "y", "width", "height")


def _lookup(n: int, owner: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.full(n, -1, dtype=np.int64)
    out[owner] = rows
    return out


class _Walk:
    """Roles of the containers of one batch, found level by level."""

    def __init__(self, ix: StructuralIndex, raw_ids: np.ndarray):
        self.ix, self.raw_ids = ix, raw_ids
        n = len(ix.start)
        up = ix.parent
        owners = np.concatenate([ix.members("pages")[0], ix.members("meta")[0]])
        has = np.zeros(n, dtype=bool)
        has[owners] = True
        # the manual: of each body the outermost such object, the first if several
        cand = np.flatnonzero(has)
        order = cand[np.lexsort((ix.start[cand], ix.depth[cand], ix.body[cand]))]
        first = np.ones(len(order), dtype=bool)
        first[1:] = ix.body[order[1:]] != ix.body[order[:-1]]
        self.is_manual = np.zeros(n, dtype=bool)
        self.is_manual[order[first]] = True
        self.has_parent = up >= 0
        self.up = np.maximum(up, 0)

    def children(self, parents: np.ndarray, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objects under ``key`` of the parent objects: container, its parent object, position."""
        ix = self.ix
        direct = ix.keyed(key) & self.has_parent & parents[self.up]
        lone = np.flatnonzero(direct & ~ix.is_array)
        arrays = direct & ix.is_array
        inside = np.flatnonzero(self.has_parent & arrays[self.up] & ~ix.is_array)
        which = np.concatenate([lone, inside])
        owner = np.concatenate([ix.parent[lone], ix.parent[ix.parent[inside]]])
        pos = np.concatenate([np.zeros(len(lone), dtype=np.int64), ix.pos[inside]])
        order = np.argsort(which, kind="stable")
        return which[order], owner[order], pos[order]


class _Parts:
    """Rows of one batch by kind: containers and positions; those of tags are spans."""

    def __init__(self, bodies: list[bytes], raw_ids: np.ndarray):
        ix = self.ix = StructuralIndex(bodies)
        walk = _Walk(ix, raw_ids)
        n = len(ix.start)
        mask = lambda which: np.bincount(which, minlength=n).astype(bool)
        page_of, block_of = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        pages, _, page_pos = walk.children(walk.is_manual, "pages")
        page_of[pages] = page_pos
        blocks, owner, block_pos = walk.children(mask(pages), "blocks")
        page_of[blocks], block_of[blocks] = page_of[owner], block_pos
        layouts, owner, _ = walk.children(mask(blocks), "layout")
        page_of[layouts], block_of[layouts] = page_of[owner], block_of[owner]
        self.metas, meta_owner, _ = walk.children(walk.is_manual, "meta")
        minus = lambda k: np.full(k, -1, dtype=np.int64)
        items = lambda which, owner, pos: (which, page_of[owner], block_of[owner], pos)
        manuals = np.flatnonzero(walk.is_manual)
        none = minus(len(manuals))
        self.rows = {
            "page": (pages, page_pos, minus(len(pages)), minus(len(pages))),
            "block": (blocks, page_of[blocks], block_pos, minus(len(blocks))),
            "segment": items(*walk.children(mask(layouts), "segments")),
            "child": items(*walk.children(mask(blocks), "children")),
            "manual": (manuals, none, none, none),
            "vertex": items(*walk.children(mask(layouts), "vertices")),
        }
        links, owner, pos = walk.children(mask(self.metas), "blog_links")
        self.rows["link"] = (links, minus(len(links)), minus(len(links)), pos)
        # where the fields of a row stand: in its own container, those of a manual in its meta
        self.holder = {kind: rows[0] for kind, rows in self.rows.items()}
        meta_of = _lookup(n, meta_owner, self.metas)
        self.holder["manual"] = meta_of[manuals]
        # tags are scalars: elements of an array, or one lone value
        owner, lo, hi = ix.members("tags")
        sel = mask(self.metas)[owner] if len(owner) else np.zeros(0, dtype=bool)
        owner, (lo, hi) = owner[sel], ix.trimmed(lo[sel], hi[sel])
        array = ix.buf[lo] == OPEN_ARRAY
        opened = np.searchsorted(ix.start, lo[array])  # containers come in the order of their opening brackets
        holder, pos, e_lo, e_hi = ix.elements(opened)
        of = _lookup(n, opened, owner[array])
        which = np.concatenate([of[holder], owner[~array]])
        pos = np.concatenate([pos, np.zeros(int((~array).sum()), dtype=np.int64)])
        lo, hi = np.concatenate([e_lo, lo[~array]]), np.concatenate([e_hi, hi[~array]])
        told = ~((hi - lo == 4) & (ix.buf[lo] == 0x6E))  # no other scalar of four bytes begins with n
        which, pos, self.tag_lo, self.tag_hi = which[told], pos[told], lo[told], hi[told]
        self.rows["tag"] = (which, minus(len(which)), minus(len(which)), pos)

    def field(self, kind: str, name: str, type_: str) -> pa.Array:
        """One field of all rows of a kind."""
        ix = self.ix
        if kind == "tag":
            return ix.texts(self.tag_lo, self.tag_hi)
        holder = self.holder[kind]
        lo, hi = self._member(holder, name)
        if type_ == "array<double>":
            return self._box(holder, lo, hi)
        values = (ix.texts if type_ == "string" else ix.numbers)(lo, hi)
        if type_ == "long":
            whole = values.to_numpy(zero_copy_only=False)
            fits = np.abs(np.nan_to_num(whole, nan=np.inf)) < 2.0**63
            return pa.array(np.where(fits, whole, 0).astype(np.int64), mask=~fits)
        return values

    def _member(self, holder: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Value span of a member of each holder, empty where it has none; of equal keys the last counts."""
        owner, lo, hi = self.ix.members(name)
        n = len(self.ix.start)
        at_lo, at_hi = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        at_lo[owner], at_hi[owner] = lo, hi
        at_lo[-1] = at_hi[-1] = 0  # holder -1
        return at_lo[holder], at_hi[holder]

    def _box(self, holder: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """Lists of numbers, of arrays or of objects with the members of a box; null for anything else."""
        ix, n = self.ix, len(holder)
        lo, hi = ix.trimmed(lo, hi)
        first = np.where(hi > lo, ix.buf[np.minimum(lo, len(ix.buf) - 1)], 0)
        opened = np.searchsorted(ix.start, lo)
        array, lone = np.flatnonzero(first == OPEN_ARRAY), np.flatnonzero(first == OPEN_OBJECT)
        row_of = _lookup(len(ix.start), opened[array], array)
        owner, pos, e_lo, e_hi = ix.elements(opened[array])
        spans = [self._member(opened[lone], c) for c in BOX]
        rows = np.concatenate([row_of[owner], np.tile(lone, len(BOX))])
        place = np.concatenate([pos, np.repeat(np.arange(len(BOX)), len(lone))])
        order = np.lexsort((place, rows))
        numbers = ix.numbers(np.concatenate([e_lo, *(a for a, _ in spans)]), np.concatenate([e_hi, *(b for _, b in spans)])).take(pa.array(order))
        offsets = np.append(0, np.cumsum(np.bincount(rows, minlength=n))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), numbers, mask=pa.array((first != OPEN_ARRAY) & (first != OPEN_OBJECT)))


def _rows(bodies: list[bytes], raw_ids: np.ndarray, kinds: tuple[str, ...], fields: dict[str, str]) -> pa.RecordBatch:
    parts = _Parts(bodies, raw_ids)
    own = [parts.rows[k] for k in kinds]
    body = np.concatenate([parts.ix.body[r[0]] for r in own]).astype(np.int64)
    code = np.repeat(np.arange(len(kinds)), [len(r[0]) for r in own])
    data = [pa.array(raw_ids[body]), pa.array(kinds).take(pa.array(code)), *(pa.array(np.concatenate([r[i] for r in own]).astype(np.int64)) for i in (1, 2, 3))]
    of_kind = {kind: table for kind, _, table in TABLES.values()}
    for name, type_ in fields.items():
        chunks = [parts.field(k, name, type_) if name in of_kind[k] else pa.nulls(len(r[0]), _ARROW[type_]) for k, r in zip(kinds, own)]
        data.append(pa.chunked_array([c.cast(_ARROW[type_]) for c in chunks], _ARROW[type_]).combine_chunks())
    return pa.RecordBatch.from_arrays(data, names=["raw_id", "kind", "page_pos", "block_pos", "item_pos", *fields])


_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _flatten(kinds: tuple[str, ...], fields: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            chunk, rows, size = [], [], 0
            for i, body in zip(ids.tolist(), batch.column(1)):
                raw = unwrap(body.as_py())
                if raw is None:
                    continue
                chunk.append(raw)
                rows.append(i)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield _rows(chunk, np.array(rows, dtype=np.int64), kinds, fields)
                    chunk, rows, size = [], [], 0
            if chunk:
                yield _rows(chunk, np.array(rows, dtype=np.int64), kinds, fields)

    return run


def _flat(manual_raw: DataFrame, kinds: tuple[str, ...], fields: dict[str, str]) -> DataFrame:
    src = manual_raw.select(F.col("raw_id").cast("long"), F.col("body").cast("string")).where("body is not null")
    return src.mapInArrow(_flatten(kinds, fields), ", ".join([POSITIONS, *(f"`{name}` {type_}" for name, type_ in fields.items())]))


def flatten_manuals(manual_raw: DataFrame, values: bool = True) -> DataFrame:
    """One row per page, block, segment, child, link and tag of every readable body, with the keys of its parents.

    With ``values`` also a row per manual and vertex, and all fields; without, the keys only.  No shuffle: bodies are
    independent.
    """
    fields = {name: type_ for _, _, table in TABLES.values() for name, type_ in table.items()} if values else {}
    return _flat(manual_raw, KINDS + MORE_KINDS if values else KINDS, fields)


def manual_table(manual_raw: DataFrame, name: str) -> DataFrame:
    """One of the related TABLES: raw_id and the positions that link its rows to their parents, and its own fields.

    Only the fields of the table are read.  Strings are as they are, null as null, other values in the place of a string
    as their JSON text; what is no number is null in the place of one.
    """
    kind, keys, fields = TABLES[name]
    return _flat(manual_raw, (kind,), fields).select("raw_id", *keys, *fields)
