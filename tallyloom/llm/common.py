"""What the corpus operators share: reading tables, batches, sizes of groups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..staging import drop_staged, shared_dir, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(df: DataFrame, name: str, kind: T.DataType) -> T.StructField:
    """The type of a column of ``df``, or ``kind`` where it has none."""
    return T.StructField(name, df.schema[name].dataType if name in df.columns else kind)


def batch_of(schema: T.StructType, columns) -> pa.RecordBatch:
    """A batch for ``mapInArrow``: values, arrays or Arrow columns in the order of ``schema``; nulls keep whole numbers whole."""
    made = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made], schema.names)


def parts_for(n: int, each: int) -> int:
    """How many groups keep each near ``each`` rows."""
    return max(1, -(-n // each))


def texts_in_blocks(texts: list[str | None], limit: int = 500_000):
    """Yield (first, last) so that a block has about ``limit`` characters; one longer text is its own block."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


__all__ = ["F", "T", "DataFrame", "SparkSession", "batch_of", "drop_staged", "field", "parts_for", "shared_dir", "stage", "table", "texts_in_blocks"]
