"""Helpers that the training-data operators share: shared storage, lineage cuts, bounded Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiframe.operators.iterate import discard, materialize, shared_dir, shared_path

__all__ = ["bounded_batches", "discard", "materialize", "shared_dir", "shared_path", "text_bytes", "with_columns_from", "words"]

#: Rows and bytes of one Arrow batch at most, so that very long texts don't add up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; a stricter setting of the user's stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", (spark.conf.get(key, None) or "").strip().lower())
        size = int(now[1]) << (10 * " kmgtp".index(now[2] or " ")) if now else 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def with_columns_from(df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., list[pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """df with the columns that a Python function makes of whole Arrow columns; every other column passes through.

    make() runs once per task and returns the function of the input columns. A column of df with the name of a new
    one is replaced by it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(df.sparkSession)
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    places = [df.columns.index(c) for c in kept]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    inputs_at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            made = work(*[b.column(i) for i in inputs_at])
            cols = [b.column(i) for i in places] + [x.cast(k) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=kept + names)

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: str = "text") -> F.Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
