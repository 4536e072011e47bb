"""Folds over long ordered groups: rows stream through a task in order and only the state is held."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def folded(df: DataFrame, key: str, order: list[str], columns: list[str], begin: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """One row a ``key``: ``end(state)`` after ``state = step(state, *columns)`` for its rows in ``order``.

    A key's rows come to one task, since each step needs the one before, but never into one
    array: however long a history is, the task holds a batch and the state.
    """
    names = [key, *[part.split()[0] for part in schema.split(", ")]]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    types = [pa.int64(), *[kinds[part.split()[1]] for part in schema.split(", ")]]

    def run(batches):
        at, state = None, None
        for batch in batches:
            rows = []
            for name, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != at or state is None:
                    if state is not None:
                        rows.append((at, *end(state)))
                    at, state = name, begin()
                state = step(state, *values)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((at, *end(state)), types, strict=True)], names)

    placed = df.repartition(key).sortWithinPartitions(key, *order).select(key, *columns)
    return placed.mapInArrow(run, f"{key} long, {schema}")
