"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: most entries of a worker's memo
MEMO_ENTRIES = 200_000


class Memo(dict):
    """A dictionary that computes what it lacks and holds at most ``limit`` entries.

    When its half is full it begins anew and keeps the former half for a second chance,
    so frequent keys stay.
    """

    def __init__(self, compute: Callable, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.half, self.former = compute, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self.former.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.half:
            self.former = dict(self)
            self.clear()
        self[key] = value
        return value


_KEPT: dict = {}


def kept(key: Hashable, make: Callable):
    """What a worker keeps between its tasks: one thing at a time.

    Workers serve one stage after another; what an earlier operator left is dropped
    before the next one builds its own, so memos never add up.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what a worker keeps, at the end of a task whose stage isn't followed by its like."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def columns_of(frame: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    Whatever else the table holds is dropped here, so extra columns can't clash
    with the columns that an operator adds.
    """
    return frame.select(*(F.col(f"`{old}`").alias(new) for new, old in names.items()))


def arrow_map(frame: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``per_batch`` over every Arrow batch of the frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield per_batch(batch)

    return frame.mapInArrow(run, schema)


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Names a row where doc_id may be missing or repeated; whole copies share it."""
    return [doc_id, F.xxhash64(text)]
