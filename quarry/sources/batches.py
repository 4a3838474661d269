"""Bounds on what a Python worker holds at once."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes in one Arrow batch handed to Python, and rows turned into results at once. A worker holds few batches at a time, so what it
#: takes is nearly the same whatever a task reads.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 32


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes. Plans are lazy, so the bound stays; it is never made looser, and no other setting
    changes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key, None) or "") or 1 << 31) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def sliced(batches, rows: int = BATCH_ROWS):
    """The batches in slices of at most so many rows."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


#: Parts of object ids. A number beyond a column's range is none that a file has; as an id it must stay one.
_IDS = ("obj_num", "gen", "src_num", "src_gen", "dst_num", "dst_gen", "object", "generation")


def fitted(value, kind: pa.DataType, name: str = ""):
    """The value where it fits in a column; what doesn't is null, or the nearest number if it is part of an object's id."""
    if value is None:
        return None
    if pa.types.is_list(kind):
        return [fitted(v, kind.value_type) for v in value] if isinstance(value, (list, tuple)) else None
    if pa.types.is_struct(kind):
        return {f.name: fitted(value.get(f.name), f.type, f.name) for f in kind} if isinstance(value, dict) else None
    if pa.types.is_map(kind):
        pairs = value.items() if isinstance(value, dict) else value if isinstance(value, list) and all(isinstance(x, tuple) and len(x) == 2 for x in value) else ()
        return [(fitted(k, kind.key_type) or "", fitted(v, kind.item_type)) for k, v in pairs]
    if pa.types.is_integer(kind):
        if not isinstance(value, int) or isinstance(value, bool):
            return None
        most = 1 << (kind.bit_width - 1)
        return value if -most <= value < most else max(-most, min(value, most - 1)) if name in _IDS else None
    if pa.types.is_string(kind):
        return value.encode("utf-8", "replace").decode("utf-8") if isinstance(value, str) else None
    try:
        return pa.scalar(value, kind).as_py()
    except (pa.ArrowException, TypeError, ValueError, OverflowError):
        return None


def array_of(rows: list, kind: pa.DataType) -> pa.Array:
    """The rows as an array, row by row fitted if they don't fit as they are."""
    try:
        return pa.array(rows, kind)
    except (pa.ArrowException, TypeError, ValueError, OverflowError):
        return pa.array([fitted(r, kind) for r in rows], kind)
