"""Shared folders, staged tables and Arrow helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent (local sessions, tests) a folder on this
    machine takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="docspark-"))
    return _LOCAL_ROOT[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folder of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_place(rows: DataFrame, name: str) -> DataFrame:
    """Staged rows with a number of their own: by the file's number and the row's place in it, whatever the rows hold."""
    file = F.col("_metadata.file_name")
    return rows.select("*", F.xxhash64(F.split(file, "-")[1], F.regexp_extract(file, r"-c(\d+)", 1), F.col("_metadata.row_index")).alias(name))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a thousand rows at most, so that their buffers stay small for whole texts too."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """``doc_id`` and the named columns only, whatever else the input carries."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)


def free_name(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores added to those that ``columns`` have already, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts, to size partitions."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def in_arrow(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` by workers that give their memory back after each task.

    Workers live on between tasks and stages; what an allocator keeps for
    itself there counts against the executor.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from f(batches)
        finally:
            trimmed()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def trimmed() -> None:
    """Hands free memory back to the system, where the C library can do so."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def filled(batch: pa.RecordBatch, name: str, value: int = 0) -> list[int]:
    return [value if x is None else x for x in batch.column(name).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int, row_bytes: int = 0) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``most_bytes`` of one column, and ``row_bytes`` a row, one row at least.

    Small batches are put together, large ones are cut, so that what a task
    holds does not follow the size of its partition.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = 0
        for i, n in enumerate(sizes):
            n += row_bytes
            if size and size + n > most_bytes:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield _joined(held)
                held, size, start = [], 0, i
            size += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def put_file(uri: str, parts: Iterable[bytes]) -> int:
    """Write a file whole or not at all: a task that is tried again replaces it by the same bytes."""
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    own, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    try:
        with store.open_output_stream(own, compression=None) as out:
            for part in parts:
                out.write(part)
                size += len(part)
        store.move(own, path)
    except BaseException:
        if store.get_file_info(own).type != pafs.FileType.NotFound:
            store.delete_file(own)
        raise
    return size


def open_file(uri: str) -> pa.NativeFile:
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
