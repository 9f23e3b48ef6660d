"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import checkpoint_dir, ship_package

# Texts handed to one numpy pass together, in bytes. A single longer text is
# processed alone, whole.
GROUP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """Ship the package to the executors and bound the Arrow batches by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: the
    lineage is cut and generated row ids are fixed."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete the table of ``stored``, once nothing will read it again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame) -> DataFrame:
    """Rows as (row_id, doc_id, text, doc): ``doc`` holds every other column, so
    no name of an operator can clash with a name in the table."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id"), F.col("text"),
        (F.struct(*rest) if rest else F.lit(None).cast("struct<none:int>")).alias("doc"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse of ``packed``, in the order of ``columns``."""
    return rows.select(*[
        F.col(c) if c in ("doc_id", "text") else F.col("doc").getField(c).alias(c) for c in columns])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8), offsets


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def release() -> None:
    """Give free memory back: a worker process stays for the next stage's tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def add_columns(df: DataFrame, make, schema: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop`` and with the columns of ``schema``, which
    ``make(batch) -> list of arrays`` computes in Arrow batches."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(schema)
    keep = [f for f in df.schema.fields if f.name not in drop]
    out = StructType(keep + new.fields)
    names, old = [f.name for f in new.fields], [f.name for f in keep]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(c)) for c in old] + make(batch), old + names)
        release()

    return df.mapInArrow(run, out)
