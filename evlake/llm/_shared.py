"""What the operators of this subpackage share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlake.operators.storage import discard, shared_dir, written, written_at  # noqa: F401

#: White space of the word and line contracts: space and \t \n \x0b \x0c \r.
SPACE = " \t\n\x0b\x0c\r"

#: Lower-cases A-Z alone; str.lower() would change other letters too.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Settings for chains of written tables: shuffle files go when a query ends, and Arrow batches are small.
_CHAIN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark deletes the shuffle files of a query when the query ends, and sends workers small batches; the session's settings come back."""
    before = {name: spark.conf.get(name) for name in _CHAIN}
    for name, value in _CHAIN.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Bytes of a batch that a worker turns into Python objects at a time, about; a longer text is alone.
BATCH_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, part_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about part_bytes, whatever the lengths of its texts."""
    if batch.nbytes <= part_bytes:
        yield batch
        return
    sizes = np.full(batch.num_rows, 64.0)
    for column in batch.columns:
        texts = [column] if not pa.types.is_struct(column.type) else column.flatten()
        for c in texts:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
            elif pa.types.is_list(c.type):
                sizes += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) // part_bytes).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _bytes(size: str) -> int:
    """What a size setting says, in bytes: "64m", "1g", "67108864" and "67108864b" alike."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40, "p": 50, "pb": 50}[unit]


def small_batches(spark: SparkSession) -> None:
    """Lowers Spark's limit of an Arrow batch, 64 MB in a fresh session, to 8 MB for the session; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(name)) <= 8 << 20:
        spark.conf.set(name, "8m")


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, part_bytes: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow in small batches, with rows() called on parts of bounded size, so that long texts stay within a worker's memory."""
    small_batches(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in slices(batch, part_bytes):
                    if (out := rows(part)) is not None:
                        yield out

    return df.mapInArrow(over, schema)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text), so that no other column of the input can clash with an operator's own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
