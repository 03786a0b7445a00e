"""Shared helpers of the Arrow-batched operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.sources import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.spread(tables.table(spark, sf_dir, name))


def values(column: pa.Array) -> list:
    """The column's values; bytes that are no UTF-8 in a string become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()]


def map_rows(df: DataFrame, schema: str, row_fn: Callable[..., Iterable[tuple]], *, batch_rows: int = 1000) -> DataFrame:
    """Flat-maps ``row_fn(*values of a row)`` over Arrow batches; output rows leave in bounded batches.

    No shuffle; one pass; a worker holds one input batch and at most ``batch_rows`` output rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(parsed)
        names = out_schema.names
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, out_schema)], schema=out_schema)
            rows.clear()
            return batch

        for batch in batches:
            for row in zip(*map(values, batch.columns)):
                rows.extend(row_fn(*row))
                if len(rows) >= batch_rows:
                    yield flush()
        if rows:
            yield flush()

    return df.mapInArrow(run, parsed)


__all__ = ["F", "map_rows", "table"]
