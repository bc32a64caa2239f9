"""Small helpers for ``mapInArrow`` functions."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


_HELD: dict[Hashable, Any] = {}


def held(name: Hashable, make: Callable[[], Any]) -> Any:
    """The cache of this name in the worker, made if need be. Spark gives a worker to one operator after
    another; it holds the cache of the one at work and lets go of any other."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Let go of what an earlier operator left in this worker."""
    _HELD.clear()


def texts_of(batch: pa.RecordBatch, name: str, limit: int = 16 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``limit`` bytes; null is the empty text."""
    column = batch.column(name).fill_null("")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(column):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield begin, column.slice(begin, end - begin).to_pylist()
        begin = end


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
