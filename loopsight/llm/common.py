"""Helpers that the operators share: scratch tables in the shared folder and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch, stored  # noqa: F401

#: ASCII white space, as every contract of this subpackage defines words by it.
SPACE = r"\x20\x09-\x0D"
#: Rows and bytes of one Arrow batch: whole texts go to Python workers, so the defaults are too many.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage so that a lost executor costs no recomputation."""
    return stored(df, name)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator is about to add (its own columns replace clashing ones)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def add_columns(df: DataFrame, text: str, added: list[T.StructField], make: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """Columns of the input plus those that make(texts) gives for each Arrow batch of texts."""
    small_batches(df.sparkSession)
    names = [f.name for f in added]
    df = without(df.withColumn("__text", F.col(f"`{text}`").cast("string")), *names)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "__text"], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            kept = [k for k in range(batch.num_columns) if k != at]
            out = make(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *out], names=[*[batch.schema.names[k] for k in kept], *names])

    return df.mapInArrow(run, schema)
