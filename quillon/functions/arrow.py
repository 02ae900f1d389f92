"""Arrow functions over arrays of pieces: what expressions could only do by copying an array for each piece."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

PIECES = "array<struct<value:string,start:int,end:int>>"


def list_of(values: pa.Array, like: pa.ListArray, lengths: np.ndarray | None = None) -> pa.ListArray:
    """A list column with the rows (or row lengths) and nulls of another one."""
    if lengths is None:
        lengths = np.asarray(pc.list_value_length(like).fill_null(0))
    offsets = np.zeros(len(like) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=like.is_null() if like.null_count else None)


def running_ends(lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``lengths`` up to and with each piece, begun anew in each row of ``rows`` pieces."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    first = np.concatenate([[0], np.cumsum(rows)])[:-1]
    return total[1:] - np.repeat(total[first], rows)


def with_offsets(pieces: Column, unit: str = "char") -> Column:
    """Array of (value, start, end) for pieces that cover their text without gaps."""
    size = pc.utf8_length if unit == "char" else pc.binary_length

    @arrow_udf(PIECES)
    def offsets(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        n = np.asarray(size(flat).fill_null(0)).astype(np.int64)
        end = running_ends(n, np.asarray(pc.list_value_length(column).fill_null(0)))
        parts = [flat.cast(pa.string()), pa.array((end - n).astype(np.int32)), pa.array(end.astype(np.int32))]
        return list_of(pa.StructArray.from_arrays(parts, ["value", "start", "end"]), column)

    return offsets(pieces)


def by_row(f: Callable[[list], list | None], returns: str, kind: pa.DataType) -> Callable[[Column], Column]:
    """A function of one row's array as a column function; null stays null."""

    @arrow_udf(returns)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([None if x is None else f(x) for x in column.to_pylist()], kind)

    return apply


def strings_by_row(f: Callable[[list], list]) -> Callable[[Column], Column]:
    return by_row(f, "array<string>", pa.list_(pa.string()))
