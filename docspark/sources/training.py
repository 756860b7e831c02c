"""Training data folders as a data source of Spark: label lines are read, images and labels written.

``spark.read.format("training_folder").load(folder)`` gives a row for each line
of each label file: split, name, line_no, line. A split is a partition of the
folder, and a filter on it keeps the others from being listed; label files are
read ``FILES`` to a task.

``rows.write.format("training_folder").mode("append").save(folder)`` takes key,
split, content (an image file) and lines (its labels). A task writes to a folder
of its own attempt below ``_staging``; when all have ended, each attempt's
folders are renamed into ``images/<split>/`` and ``labels/<split>/``, a handful
for each task, and ``data.yaml``, which makes a folder a data set, is written
last. Tasks that die and jobs that fail leave nothing there: what they staged is
removed, or never read.

Folders go through Arrow's file systems (local, HDFS, S3, GCS), not through a
path of this machine. Defined results: rows without key, split or image are
left out; null lines are an image without labels; blank lines are read as lines;
a folder without labels, or an empty table, gives no rows, and writing an empty
table still makes an empty data set. Keys must be unique: of equal ones, each
has a file in the folder of its task.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from docspark import dims

FILES = 500
NAME = "training_folder"
SPLITS = ("train", "val")
STAGING = "_staging"


def _opened(options: dict) -> tuple[pafs.FileSystem, str]:
    path = options.get("path")
    if not path:
        raise ValueError("a path is needed")
    return pafs.FileSystem.from_uri(path)


def _under(store: pafs.FileSystem, folder: str, kind: pafs.FileType, recursive: bool = False) -> list[str]:
    chosen = pafs.FileSelector(folder, allow_not_found=True, recursive=recursive)
    return sorted(i.path for i in store.get_file_info(chosen) if i.type == kind)


@dataclass
class Labels(InputPartition):
    split: str
    files: list[str]


class LabelReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.splits = options, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("split",):
                yield f
                continue
            self.splits = wanted if self.splits is None else self.splits & wanted

    def partitions(self) -> list[Labels]:
        store, root = _opened(self.options)
        there = [posixpath.basename(p) for p in _under(store, f"{root}/labels", pafs.FileType.Directory)]
        out = []
        for split in there:
            if self.splits is None or split in self.splits:
                files = [p for p in _under(store, f"{root}/labels/{split}", pafs.FileType.File, recursive=True) if p.endswith(".txt")]
                out += [Labels(split, files[at : at + FILES]) for at in range(0, len(files), FILES)]
        return out or [Labels("", [])]

    def read(self, partition: Labels) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.options)
        for file in partition.files:
            with store.open_input_file(file) as f:
                text = f.read().decode("utf-8")
            lines = text.split("\n") if text else []
            name = posixpath.basename(file).removesuffix(".txt")
            n = len(lines)
            yield pa.RecordBatch.from_arrays([pa.array([partition.split] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array(lines, pa.string())], names=["split", "name", "line_no", "line"])


@dataclass
class Attempt(WriterCommitMessage):
    name: str
    images: dict[str, int]


class FolderWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        if missing := {"key", "split", "content", "lines"} - set(schema.names):
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        self.options, self.suffix, self.job = options, options.get("suffix", "ppm"), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Attempt:
        store, root = _opened(self.options)
        attempt = Attempt(uuid.uuid4().hex, {})
        made = set()

        def put(kind: str, split: str, name: str, data: bytes) -> None:
            folder = f"{root}/{STAGING}/{self.job}/{attempt.name}/{kind}/{split}"
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(data)

        for row in iterator:
            if row["key"] is None or row["split"] is None or row["content"] is None:
                continue
            put("images", row["split"], f"sample_{row['key']}.{self.suffix}", bytes(row["content"]))
            put("labels", row["split"], f"sample_{row['key']}.txt", "\n".join(x for x in row["lines"] or [] if x is not None).encode())
            attempt.images[row["split"]] = attempt.images.get(row["split"], 0) + 1
        return attempt

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _opened(self.options)
        for kind in ("images", "labels"):
            for split in SPLITS:
                store.create_dir(f"{root}/{kind}/{split}", recursive=True)
        for m in messages:
            for split in m.images if m else ():
                for kind in ("labels", "images"):  # an image never stands without its labels
                    store.create_dir(f"{root}/{kind}/{split}", recursive=True)
                    store.move(f"{root}/{STAGING}/{self.job}/{m.name}/{kind}/{split}", f"{root}/{kind}/{split}/{m.name}")
        names = "".join(f"  {i}: {c}\n" for i, c in enumerate(dims.CLASSES))
        with store.open_output_stream(f"{root}/data.yaml", compression=None) as out:
            out.write(f"path: {root}\ntrain: images/train\nval: images/val\n\nnames:\n{names}".encode())
        self.abort([])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _opened(self.options)
        staged = f"{root}/{STAGING}/{self.job}"
        if store.get_file_info(staged).type == pafs.FileType.Directory:
            store.delete_dir(staged)


class TrainingFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "split string, name string, line_no int, line string"

    def reader(self, schema: StructType) -> LabelReader:
        return LabelReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        if overwrite:
            raise ValueError("a training folder is only added to")
        return FolderWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrainingFolder)
