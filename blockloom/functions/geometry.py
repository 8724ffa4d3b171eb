"""Bounding boxes (x, y, width, height in 0-1) as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Box of a new block.
NEW_BOX = (0.4, 0.45, 0.2, 0.1)
LEAST_SIZE = 0.01


def is_box(b: Column) -> Column:
    """Four numbers, none null or NaN; false for null."""
    return F.coalesce((F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))


def clamp(b: Column) -> Column:
    """The box within the page, null if it is none; at the far edge it keeps its least size."""
    one, zero, least = F.lit(1.0), F.lit(0.0), F.lit(LEAST_SIZE)
    x, y = F.greatest(zero, F.least(one, F.get(b, F.lit(0)))), F.greatest(zero, F.least(one, F.get(b, F.lit(1))))
    w = F.greatest(least, F.least(one - x, F.get(b, F.lit(2))))
    h = F.greatest(least, F.least(one - y, F.get(b, F.lit(3))))
    return F.when(is_box(b), F.array(x, y, w, h))


def percent(b: Column) -> Column:
    return F.transform(b, lambda v: v * 100)


def pixels(b: Column, width: int, height: int) -> Column:
    """Whole pixels, cut towards zero."""
    scale = (width, height, width, height)
    return F.when(is_box(b), F.array(*((F.get(b, F.lit(i)) * s).cast("int") for i, s in enumerate(scale))))


def large_enough(p: Column, least: int = 10) -> Column:
    """Whether a box in pixels is at least so wide and high."""
    return (F.get(p, F.lit(2)) >= least) & (F.get(p, F.lit(3)) >= least)


def font_size(height: Column) -> Column:
    """Half the height in whole points, 10 to 14."""
    return F.greatest(F.lit(10), F.least(F.lit(14), (height * 0.5).cast("int")))


def shown(b: Column) -> Column:
    """Two decimals of each number, ties away from zero."""
    return F.transform(b, lambda v: F.format_string("%.2f", F.round(v * 100) / 100))


def render_zoom(width: Column, height: Column, dpi: int = 200, most: int = 9500, target: int = 7000) -> Column:
    """Zoom to draw a page of so many points, less where the larger side would exceed the most pixels."""
    larger = F.greatest(width, height)
    zoom = F.lit(dpi / 72.0)
    return F.when(larger * zoom > most, F.lit(float(target)) / larger).otherwise(zoom)


def image_form(size: Column, most: int = 10_000_000) -> Column:
    """(mime, quality) in which a picture of so many bytes as PNG is sent: above the most bytes as JPEG."""
    large = size > most
    return F.struct(F.when(large, F.lit("image/jpeg")).otherwise(F.lit("image/png")).alias("mime"), F.when(large, F.lit(95)).alias("quality"))


def from_polygon(v: Column) -> Column:
    """Box from the first and third corner; null with fewer than four."""
    a, c = F.get(v, F.lit(0)), F.get(v, F.lit(2))
    x, y = F.coalesce(a["x"], F.lit(0.0)), F.coalesce(a["y"], F.lit(0.0))
    return F.when(F.size(v) >= 4, F.array(x, y, F.coalesce(c["x"], F.lit(0.0)) - x, F.coalesce(c["y"], F.lit(0.0)) - y))


def anchored(text: Column, segments: Column) -> Column:
    """Pieces of a text at segments (start, end); a missing start is 0; null without a text."""
    piece = lambda s: F.substring(text, F.coalesce(s["start"], F.lit(0)).cast("int") + 1, (s["end"] - F.coalesce(s["start"], F.lit(0))).cast("int"))
    joined = F.array_join(F.transform(F.filter(segments, lambda s: s["end"] > F.coalesce(s["start"], F.lit(0))), piece), "")
    return F.when(text.isNotNull(), joined)


def _round4(values: np.ndarray) -> np.ndarray:
    """Rounded to four decimals as decimal text of binary numbers is; only values next to a tie are rounded one by one."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = values * 1e4
        out = np.rint(scaled) / 1e4
        tie = np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-4
        exact = np.flatnonzero(tie | (np.abs(scaled) > 1e11))
    out[exact] = [round(v, 4) for v in values[exact].tolist()]
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def round4(boxes: pa.Array) -> pa.Array:
    """Four decimals, half to even on the exact value; all numbers of a batch at once.  A NaN becomes null."""
    flat = boxes.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    rounded = pa.array(_round4(values), from_pandas=True)
    size = np.where(np.asarray(boxes.is_valid()), np.asarray(pc.fill_null(pc.list_value_length(boxes), 0)), 0)
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), rounded, mask=boxes.is_null())
