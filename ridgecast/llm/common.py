"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: The six ASCII white-space characters that separate words in every contract.
SPACES = " \t\n\x0b\x0c\r"
#: The same class for Java regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Rows per Arrow batch: texts can be long, so batches stay small.
BATCH_ROWS = 512
#: Bytes (counted rows times a row's width) up to which a narrow table is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; without one in the session a fresh local one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ridgecast-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._ridgecast_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing will read again; other DataFrames are left alone."""
    for table in tables:
        if path := getattr(table, "_ridgecast_path", None):
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def row_bytes(df: DataFrame) -> int:
    """A row's width in memory for fixed-size columns; a string, array or binary counts as 64 bytes."""
    return 16 + sum(8 if f.dataType.typeName() in ("long", "integer", "double", "boolean", "float", "short", "byte") else 64 for f in df.schema.fields)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (narrow, on disk), to be broadcast if its counted rows make no more than so many bytes."""
    return F.broadcast(df) if df.count() * row_bytes(df) <= most else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, made of name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def python_workers(spark: SparkSession) -> None:
    """Ship the package and bound the Arrow batches that go to Python workers."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def held_out(doc_id):
    """True where crc32 of the id's decimal text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def single_thread() -> None:
    """Spark schedules the cores; tokenizers must not start threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_buffer(array):
    """The UTF-8 bytes and the offsets (from 0, one more than rows) of a string array; nulls are empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    large = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return body, off - off[0]
