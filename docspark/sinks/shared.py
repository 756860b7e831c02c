"""Folders that driver and executors share, and small files in them, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only local sessions without that setting use a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="docspark-"))
    return _LOCAL_ROOT[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted; nothing where there is none."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless there is one already: then False, and nothing changes.

    The file is written beside its place and renamed without overwriting, which
    HDFS does at once; a file system that checks first and renames then leaves a
    moment in which two writers may both believe that they were first.
    """
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, p = _at(spark, own)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    to = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(fs.makeQualified(p), to, options)
    except Py4JJavaError as e:
        fs.delete(p, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back, where several branches of a plan would compute them again."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
