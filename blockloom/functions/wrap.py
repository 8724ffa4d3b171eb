"""Wrapping of text into boxes: sequential, so in vectorised Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest and least font size that is tried.
LARGEST, LEAST = 14, 8
_SPACE = r"[\s\x1c-\x1f]"
_MARK = re.compile(rf"(?:\d+[.)]|[①-⑩]|\(\d+\)|[・•\-●○■□★☆※]){_SPACE}*")


def start_size(height: int) -> int:
    """Half the height of the box in whole points, 10 to 14."""
    return max(10, min(LARGEST, int(height * 0.5)))


def wrap_item(text: str, width: int, size: int) -> list[tuple[str, int]]:
    """(line, indent) of one item: greedy lines of words; lines after the first hang under the text behind its mark.

    A character is half the font size wide.  The mark stands before the first line and isn't counted in its width.
    """
    m = _MARK.match(text)
    mark = m[0] if m else ""
    indent = len(mark) * size // 2
    lines: list[tuple[str, int]] = []
    line = ""

    def close() -> None:
        lines.append((line, indent) if lines and mark else (mark + line, 0))

    for word in text[len(mark) :].split():
        longer = f"{line} {word}" if line else word
        if len(longer) * size // 2 <= (width - indent if lines and mark else width) or not line:
            line = longer
        else:
            close()
            line = word
    if line:
        close()
    return lines


def fit(items: list[str], width: int, height: int) -> tuple[int, list[tuple[str, int]]]:
    """Font size and lines: from the box's own size down to the least whose lines fit it; one less if none does.

    Widths are those of the first size: without a font only the height of a line shrinks.
    """
    size = start_size(height)
    lines = [line for item in items for line in wrap_item(item, width, size)]
    while size >= LEAST and len(lines) * (size + 2) > height:
        size -= 1
    return size, lines


_LINE = T.StructType([T.StructField("line", T.StringType()), T.StructField("indent", T.IntegerType())])


@F.pandas_udf(T.StructType([T.StructField("size", T.IntegerType()), T.StructField("lines", T.ArrayType(_LINE))]))
def fit_text(items: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Font size and (line, indent) of the items of a text (split_list) in a box in pixels; null where one is missing."""
    out = []
    for t, w, h in zip(items, width, height):
        if t is None or pd.isna(w) or pd.isna(h):
            out.append((None, None))
        else:
            size, lines = fit(list(t), int(w), int(h))
            out.append((size, [{"line": a, "indent": b} for a, b in lines]))
    return pd.DataFrame(out, columns=["size", "lines"])
