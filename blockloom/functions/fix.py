"""Repair of text that was decoded wrongly as a whole, for stage 1 of the clean-up.

The library ftfy does it where it is installed.  Else a subset: the value is taken back to bytes as Windows-1252 or
Latin-1 and read as UTF-8, if that is possible for the whole value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from ftfy import fix_text as _fix
except ImportError:

    def _fix(text: str) -> str:
        for wrong in ("cp1252", "latin-1"):
            try:
                return text.encode(wrong).decode("utf-8")
            except UnicodeError:
                continue
        return text


@F.arrow_udf(T.StringType())
def fix_text(values: pa.Array) -> pa.Array:
    """The repaired values; ASCII ones and nulls, found a batch at once, as they are."""
    at = np.flatnonzero(~np.asarray(pc.fill_null(pc.string_is_ascii(values), True)))
    if not len(at):
        return values
    own = values.take(pa.array(at))
    mask = np.zeros(len(values), dtype=bool)
    mask[at] = True
    return pc.replace_with_mask(values, pa.array(mask), pa.array([_fix(v) for v in own.to_pylist()], values.type))
