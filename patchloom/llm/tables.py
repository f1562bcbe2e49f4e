"""Small helpers shared by the operators: tables, Arrow batches, stored intermediate results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from patchloom.session import materialize

__all__ = ["materialize", "slices", "table"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a Python task works on at a time, and the bytes of text among them.
SLICE_ROWS, SLICE_BYTES = 2048, 1_000_000


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches: so many rows, and SLICE_BYTES in the column `text`, or one row if that is longer."""
    for batch in batches:
        if text is None:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
            continue
        upto = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = int(np.searchsorted(upto, before + SLICE_BYTES, "right"))
            end = min(max(end, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
