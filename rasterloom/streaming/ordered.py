"""Recurrences along an order: rows of a key in order through a step that carries a state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def carried(df: DataFrame, key: list[str], order: list[str], start: object, step: Callable[[object, tuple], tuple[object, tuple]], schema: str) -> DataFrame:
    """What step(state, row) -> (state, out) gives of each row; each key begins with `start`.

    Rows are shuffled by key and sorted on disk if need be; a task holds a batch and one state, however
    long a key's run is.
    """
    of = [df.columns.index(k) for k in key]
    full = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, here, state = to_arrow_schema(full), None, start
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                at = (tuple(row[k] for k in of),)
                if at != here:
                    here, state = at, start
                state, made = step(state, row)
                out.append(made)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.repartition(*key).sortWithinPartitions(*chain(key, order)).mapInArrow(run, full)
