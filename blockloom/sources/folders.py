"""Files of manuals, written and read by the executors as streams, many to a task.

Spark's own writer and reader cost several tasks, renames and processes a file, and its reader makes one row of a manual.
Here a task writes what comes sorted by manual, and reads a list of folders.  A file in which each value has the type it
should have is taken apart here, a large one piece by piece; any other is handed on as text, for Spark's parser to judge.
"""

from __future__ import annotations

import codecs
import json
import math
import re
import uuid
from collections.abc import Iterator
from functools import cache, partial
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs

FILE = "translations.json"
#: Bytes up to which a file is parsed as a whole, and those read at once of a larger one.
WHOLE, CHUNK = 1 << 23, 1 << 20
#: Rows and characters of a batch.
ROWS, CHARS = 4096, 1 << 22
BLOCKS = pa.schema([("manual", pa.string()), ("page_idx", pa.int64()), ("block_idx", pa.int64()), ("text", pa.string()), ("translation", pa.string()), ("bbox", pa.list_(pa.float64())), ("raw", pa.string())])
HEADS = pa.schema([("manual", pa.string()), ("head", pa.string()), ("n_pages", pa.int64()), ("n_blocks", pa.int64()), ("image", pa.string()), ("raw", pa.string()), ("broken", pa.bool_())])

_STRINGS = ("manual_name", "source", "source_lang", "target_lang", "source_url", "blog_url", "thumbnail")
_COUNTS = ("pages", "blocks")
_LINK = ("title", "url", "translated_url")
#: Numbers that JSON has no form for, as Spark writes and reads them.
_SPECIAL = {"NaN": math.nan, "Infinity": math.inf, "+Infinity": math.inf, "+INF": math.inf, "-Infinity": -math.inf, "-INF": -math.inf}
_surrogate = re.compile(r"\\u[dD][89a-fA-F]")
_space = re.compile(r"[ \t\n\r]*")


class Odd(ValueError):
    """A file that Spark's parser has to judge."""


def _odd(*_) -> None:
    raise Odd


class _Literal(str):
    """A number as it stands in the file."""


#: The second is for files with numbers in place of strings.
_decoders = json.JSONDecoder(parse_constant=_odd), json.JSONDecoder(parse_constant=_odd, parse_float=_Literal, parse_int=_Literal)


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), unquote(urlsplit(uri).path)) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


# -- writing


def write(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """Lines (manual, line), each with its line end, sorted by manual, into a file a manual.

    A file has its name only when it is whole, so that a task may be tried again.
    """
    files, root = _files(uri)
    mark, name, part, out, n = f".{FILE}.{uuid.uuid4().hex}", None, "", None, 0

    def close() -> None:
        out.close()
        files.move(part, f"{root}/{name}/{FILE}")

    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            names, lines = batch.column(0), batch.column(1).cast(pa.large_string())
            ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
            starts = [0, *(np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()]
            for a, b in zip(starts, [*starts[1:], len(names)]):
                own = names[a].as_py()
                if own != name:
                    if out is not None:
                        close()
                    name, part = own, f"{root}/{own}/{mark}"
                    files.create_dir(f"{root}/{own}")
                    out = files.open_output_stream(part)
                    n += 1
                out.write(lines.buffers()[2].slice(ends[a], ends[b] - ends[a]))
        if out is not None:
            close()
    except BaseException:
        if out is not None and not out.closed:
            out.close()
            files.delete_file(part)
        raise
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


# -- reading


def folders(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """(manual) of each folder under uri, for each row given."""
    for batch in batches:
        for _ in range(batch.num_rows):
            files, root = _files(uri)
            names = pa.array([f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory], pa.string())
            for k in range(0, len(names), ROWS):
                yield pa.RecordBatch.from_arrays([names[k : k + ROWS]], names=["manual"])


class _Pieces:
    """Values of a JSON text, one after the other, of which no more is held than a value needs."""

    def __init__(self, stream, encoding: str, decoder: json.JSONDecoder) -> None:
        self.raw_decode = decoder.raw_decode
        self.stream, self.decode = stream, codecs.getincrementaldecoder(encoding)().decode
        self.text, self.at, self.ended = "", 0, False

    def more(self) -> None:
        data = self.stream.read(max(CHUNK, 2 * (len(self.text) - self.at)))
        self.ended = not data
        new = self.decode(data, self.ended)
        self.text, self.at = self.text[self.at :] + new, 0
        if _surrogate.search(self.text):
            raise Odd

    def peek(self) -> str:
        while True:
            self.at = _space.match(self.text, self.at).end()
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self.more()

    def take(self, sign: str) -> bool:
        if self.peek() == sign:
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        self.take(sign) or _odd()

    def value(self):
        self.peek()
        while True:
            try:
                found, end = self.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:
                    self.at = end
                    return found
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.more()

    def items(self) -> Iterator[int]:
        """Numbers of a list's items, each of which is to be taken before the next."""
        self.need("[")
        if not self.take("]"):
            k = 0
            yield k
            while self.take(","):
                k += 1
                yield k
            self.need("]")

    def keys(self) -> Iterator[str]:
        """Keys of an object, each once, whose values are to be taken before the next."""
        self.need("{")
        if not self.take("}"):
            seen = set()
            while True:
                key = self.value()
                if type(key) is not str or key in seen:
                    raise Odd
                seen.add(key)
                self.need(":")
                yield key
                if not self.take(","):
                    break
            self.need("}")


def _by_pieces(pieces: _Pieces) -> Iterator[tuple]:
    """(page, block number, block); block number -1 for the end of a page, with its image; page -1 for the header."""
    listed = False
    for key in pieces.keys():
        if key == "pages" and pieces.peek() == "[":
            listed = True
            for p in pieces.items():
                image = None
                if pieces.peek() == "{":
                    for inner in pieces.keys():
                        if inner == "blocks" and pieces.peek() == "[":
                            for b in pieces.items():
                                yield p, b, pieces.value()
                        elif inner == "blocks":
                            pieces.value() is None or _odd()
                        elif inner == "image":
                            image = pieces.value()
                        else:
                            pieces.value()
                else:
                    pieces.value() is None or _odd()
                yield p, -1, image
        elif key == "pages":
            pieces.value() is None or _odd()
        elif key == "meta":
            yield -1, -1, pieces.value()
        else:
            pieces.value()
    if pieces.peek():
        raise Odd
    yield -2, -1, listed


def _at_once(whole) -> Iterator[tuple]:
    """As _by_pieces, of what is parsed already."""
    if type(whole) is not dict:
        raise Odd
    yield -1, -1, whole.get("meta")
    pages = whole.get("pages")
    if pages is not None:
        if type(pages) is not list:
            raise Odd
        for p, page in enumerate(pages):
            if page is None:
                yield p, -1, None
                continue
            if type(page) is not dict:
                raise Odd
            blocks = page.get("blocks")
            if blocks is not None:
                if type(blocks) is not list:
                    raise Odd
                for b, block in enumerate(blocks):
                    yield p, b, block
            yield p, -1, page.get("image")
    yield -2, -1, pages is not None


def _string(v) -> bool:
    return v is None or isinstance(v, str)


def _number(v) -> float | None:
    if v is None or type(v) is float:
        return v
    if type(v) is int:
        try:
            return float(v)
        except OverflowError:
            raise Odd from None
    if type(v) is _Literal:
        return float(v)
    return _SPECIAL[v] if type(v) is str and v in _SPECIAL else _odd()


def _block(block) -> tuple:
    """text, translation and bbox of a block."""
    if block is None:
        return None, None, None
    if type(block) is not dict:
        raise Odd
    text, translation, bbox = block.get("text"), block.get("translation"), block.get("bbox")
    if not (_string(text) and _string(translation)):
        raise Odd
    if bbox is not None:
        if type(bbox) is not list:
            raise Odd
        bbox = [v if type(v) is float else _number(v) for v in bbox]
    return text, translation, bbox


def _head(meta) -> str | None:
    """The known fields of a header as JSON."""
    if meta is None:
        return None
    if type(meta) is not dict:
        raise Odd
    meta = meta | {k: int(v) for k in _COUNTS if type(v := meta.get(k)) is _Literal and re.fullmatch(r"-?\d+", v)}
    tags, links = meta.get("tags"), meta.get("blog_links")
    sound = all(_string(meta.get(k)) for k in _STRINGS) and all(meta.get(k) is None or type(meta[k]) is int and abs(meta[k]) < 1 << 63 for k in _COUNTS)
    sound = sound and (tags is None or type(tags) is list and all(map(_string, tags)))
    sound = sound and (links is None or type(links) is list and all(x is None or type(x) is dict and all(_string(x.get(k)) for k in _LINK) for x in links))
    if not sound:
        raise Odd
    return json.dumps({k: meta[k] for k in (*_STRINGS, *_COUNTS, "tags", "blog_links") if k in meta}, ensure_ascii=False)


def _summed(events: Iterator[tuple]) -> tuple:
    """head, n_pages, n_blocks, image of the first page; an error unless each value has its type."""
    head, image, n_pages, n_blocks, listed = None, None, 0, 0, False
    for page, b, value in events:
        if b >= 0:
            _block(value)
            n_blocks += 1
        elif page >= 0:
            if not _string(value):
                raise Odd
            image = value if page == 0 else image
            n_pages += 1
        elif page == -1:
            head = _head(value)
        else:
            listed = value
    return (head, n_pages, n_blocks, image) if listed else (head, None, None, None)


def _read(files: fs.FileSystem, path: str, size: int):
    """What gives the events of a file under one of the decoders, as often as it is called, and what gives its text."""
    with files.open_input_stream(path) as f:
        first = f.read(size if size <= WHOLE else 4)
    encoding = json.detect_encoding(first)
    if size <= WHOLE:
        text = first.decode(encoding)

        @cache
        def parsed(decoder):
            return _odd() if _surrogate.search(text) else decoder.decode(text)

        return (lambda decoder: _at_once(parsed(decoder))), (lambda: text)

    def events(decoder: json.JSONDecoder) -> Iterator[tuple]:
        with files.open_input_stream(path) as f:
            yield from _by_pieces(_Pieces(f, encoding, decoder))

    def whole() -> str:
        with files.open_input_stream(path) as f:
            return f.read().decode(encoding)

    return events, whole


def _each(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[tuple]:
    """(manual, events, summed, raw) of each file: summed if each value has its type, raw else; both None if it is no text."""
    files, root = _files(uri)
    for batch in batches:
        names = batch.column(0).to_pylist()
        for name, info in zip(names, files.get_file_info([f"{root}/{x}/{FILE}" for x in names])):
            if info.type != fs.FileType.File:
                continue
            events, summed, raw = None, None, None
            try:
                read, text = _read(files, info.path, info.size)
                for decoder in _decoders:
                    try:
                        events = partial(read, decoder)
                        summed = _summed(events())
                        break
                    except UnicodeDecodeError:
                        raise
                    except (ValueError, RecursionError):
                        pass
                else:
                    raw = text()
                    if not raw.strip(" \t\r\n"):
                        continue  # an empty file is no manual
            except UnicodeDecodeError:
                raw = None
            yield name, events, summed, raw


def heads(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """HEADS of the manuals named."""
    rows, chars = [], 0
    for name, _, summed, raw in _each(batches, uri):
        rows.append((name, *(summed or (None,) * 4), raw, summed is None and raw is None))
        chars += len(raw or "") + 200
        if len(rows) >= ROWS or chars >= CHARS:
            yield _batch(rows, HEADS)
            rows, chars = [], 0
    if rows:
        yield _batch(rows, HEADS)


def blocks(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """BLOCKS of the manuals named that have a header and pages; a file as it is for one that is odd."""
    rows, chars = [], 0
    for name, events, summed, raw in _each(batches, uri):
        if raw is not None:
            rows.append((name, None, None, None, None, None, raw))
            chars += len(raw)
        elif summed and summed[0] is not None and summed[1] is not None:
            for page, b, value in events():
                if b >= 0:
                    text, translation, bbox = _block(value)
                    rows.append((name, page, b, text, translation, bbox, None))
                    chars += len(text or "") + len(translation or "")
                    if len(rows) >= ROWS or chars >= CHARS:
                        yield _batch(rows, BLOCKS)
                        rows, chars = [], 0
        if chars >= CHARS:
            yield _batch(rows, BLOCKS)
            rows, chars = [], 0
    if rows:
        yield _batch(rows, BLOCKS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
