"""Folds over the sorted rows of each key that keep a small state and no array of the key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shipping import ship_package


def fold_column(df: DataFrame, keys: list[str], order: list[Column], inputs: list[str], name: str, kind: str, fresh: Callable[[], Callable[..., Any]]) -> DataFrame:
    """df with a column more, told row by row in the given order within each key.

    fresh() begins a key and returns a function from a row's inputs to its value; what that function holds is the key's state. Rows
    are sorted by Spark and pass through in Arrow batches, so a key of any size needs the memory of a batch and of its state.
    `order` must tell rows apart where it matters.
    """
    ship_package(df.sparkSession)
    own, read = [df.columns.index(k) for k in keys], [df.columns.index(c) for c in inputs]
    told = to_arrow_type(df.sparkSession.range(0).select(F.lit(None).cast(kind).alias("x")).schema["x"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        step: Callable[..., Any] = fresh()
        for batch in batches:
            out = []
            named = zip(*(batch.column(k).to_pylist() for k in own), strict=True)
            values = zip(*(batch.column(k).to_pylist() for k in read), strict=True)
            for now, value in zip(named, values, strict=True):
                if now != key:
                    key, step = now, fresh()
                out.append(step(*value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, told)], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, (name, kind)])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(scan, schema)
