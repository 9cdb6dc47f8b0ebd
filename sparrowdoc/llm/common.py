"""Scratch tables in the shared folder and Arrow kernels that work slice by slice."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: Rows and text bytes that a kernel gets at once; a single longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files that led here
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of a few MB, so that workers hold little; a size that the session was given stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch within SLICE_ROWS and SLICE_BYTES."""
    at, n = 0, batch.num_rows
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist() if n else []
    while at < n:
        end, total = at, 0
        while end < n and end - at < SLICE_ROWS and (end == at or total + sizes[end] <= SLICE_BYTES):
            total += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def annotate(df: DataFrame, text_col: str, factory: Callable[[], Callable], fields: list[T.StructField], replace_text: bool = False) -> DataFrame:
    """Append computed columns, one kernel for each task.

    ``factory()`` gives a kernel from a list of texts (None for null) to a list of columns. An input column named
    as a computed one gives way to it. ``replace_text``: the kernel's first column takes the text's place.
    """
    small_batches(df.sparkSession)
    names = [f.name for f in fields]
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    schema = T.StructType(base.schema.fields + fields)
    at = base.columns.index(text_col)

    def run(batches):
        kernel = factory()
        for whole in batches:
            for b in slices(whole, text_col):
                cols = kernel(b.column(text_col).to_pylist())
                own = list(b.columns)
                if replace_text:
                    own[at] = pa.array(cols[0], b.schema.field(at).type)
                    cols = cols[1:]
                yield pa.RecordBatch.from_arrays(own + [pa.array(c) if not isinstance(c, pa.Array) else c for c in cols], names=[*b.schema.names, *names])

    return base.mapInArrow(run, schema)


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def binary(name: str) -> T.StructField:
    return T.StructField(name, T.BinaryType())


def boolean(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())
