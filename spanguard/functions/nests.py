"""Values of nested Arrow lists on their own, and nested again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[pa.Array, list]:
    """The innermost values of nested lists, and what is needed to nest others like them."""
    levels = []
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        levels.append((column.value_lengths().fill_null(0), column.is_null()))
        column = column.flatten()
    return column, levels


def nested(values: pa.Array, levels: list) -> pa.Array:
    for lengths, nulls in reversed(levels):
        ends = np.cumsum(np.concatenate([[0], lengths.to_numpy()])).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), values, mask=nulls)
    return values
