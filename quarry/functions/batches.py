"""Readers over texts, a row at a time in Arrow batches whose bytes are bounded both ways."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

#: Bytes of a batch that goes to a Python worker, and about the characters of one that comes back.
BATCH_BYTES = 4 << 20
#: Rows of a batch that comes back.
BATCH_ROWS = 20_000


def small_batches(spark: SparkSession) -> None:
    """From now on texts go to Python workers in batches of BATCH_BYTES, or what the session has set below that."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def read_rows(files: DataFrame, columns: Iterable[Column | str], read: Callable[..., Iterable[tuple]], schema: str, weigh: Callable[[tuple], int] = lambda row: 0) -> DataFrame:
    """The rows that `read` gives for each row of these columns; weigh: about the characters of those that may be long."""
    small_batches(files.sparkSession)
    arrow = to_arrow_schema(DataType.fromDDL(schema))

    def lot(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(zip(*rows), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for row in read(*own):
                    rows.append(row)
                    held += weigh(row)
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield lot(rows)
                        rows, held = [], 0
        if rows:
            yield lot(rows)

    return files.select(*columns).mapInArrow(run, schema)
