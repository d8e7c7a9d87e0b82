"""What the operators of this subpackage share: the shared folder, stage tables, Arrow helpers, words."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python: texts may be long, so batches are kept short.
BATCH_ROWS = 1024
#: Frees the shuffle files of a finished query, so that a chain of stage tables needs the disk of one step only.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that every query here relies on; all can be changed at run time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set(CLEANUP, "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or on a local master a temporary one."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a stage table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_id(df: DataFrame, column: str) -> Column:
    return df[column].cast("long")


def utf8(column: str | Column) -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")).cast("binary")


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def words(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D: bytes.split() parts at exactly these."""
    return text.split()


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def batch_of(ddl: str, columns: list) -> pa.RecordBatch:
    """A batch with the fields of a "name type, name type" list; columns: Arrow or NumPy arrays, or lists."""
    fields = [pa.field(x.split(" ")[0], ARROW[x.split(" ")[1]]) for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


#: What operators keep between the tasks of a worker; each entry drops one cache.
CACHES: list = []
_owner = ""


def begin(owner: str) -> None:
    """Called when a task starts: a worker that last served another operator gives back what that one kept."""
    global _owner
    if owner == _owner:
        return
    _owner = owner
    for drop in CACHES:
        drop()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of `column`, one row at least: bounds a task's memory."""
    for batch in batches:
        size = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        ends, begin = np.cumsum(np.nan_to_num(np.asarray(size.to_numpy(zero_copy_only=False), dtype=np.float64))), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0.0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
