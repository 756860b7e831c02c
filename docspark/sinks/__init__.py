"""Shapes in which results are stored."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import dims


def sink_projection(rows: DataFrame, model_version: str = "v1") -> DataFrame:
    """The stored columns of uploads joined to their flat records; a date that is none is stored as null."""
    json = F.to_json(F.struct(*[c for c in rows.columns if c not in ("content", "id")]), {"ignoreNullFields": "false"})
    return rows.withColumns(
        {
            "image_mime_type": F.coalesce(F.nullif("image_mime_type", F.lit("")), F.lit("application/octet-stream")),
            "image_sha256": F.sha2("content", 256),
            "birth_date": F.col("birth_date").try_cast("date"),
            "ocr_result": json,
            "ocr_model_version": F.lit(model_version),
        }
    ).withColumnRenamed("content", "card_image")


def append(rows: DataFrame, path: str) -> None:
    """Stored rows are never changed: each run adds files."""
    rows.write.mode("append").parquet(path)


def append_jdbc(rows: DataFrame, table: str, options: dict[str, str]) -> None:
    rows.write.mode("append").format("jdbc").options(**options, dbtable=table).save()


def batch_map(records: DataFrame, by: str) -> DataFrame:
    """name and record of each row as one JSON object for each ``by``; a group is a folder that one report covers."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "record"))))
    return records.groupBy(by).agg(F.to_json(entries, {"ignoreNullFields": "false"}).alias("records"))


def dataset_split(key: Column, folds: int) -> Column:
    """Every ``folds``-th key for validation, so a row stays where it is when others come."""
    return F.when(key % folds == 0, "val").otherwise("train")


def _put(path: Path, data: bytes) -> None:
    """Whole or not at all, so a task that runs again puts the same file there."""
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_bytes(data)
    os.replace(part, path)


def write_dataset(rows: DataFrame, folder: str, folds: int = 5, suffix: str = "ppm") -> DataFrame:
    """A training data folder of key, content (an image file) and lines (its labels); a row for each split with its number of images.

    Each key, which must be unique, gives ``images/<split>/sample_<key>`` and a
    file of labels beside it, written by the task that holds the row;
    ``data.yaml`` names the classes. ``folder`` must be one that driver and
    executors share. Rows without a key or an image are left out; null lines are
    an image without labels.
    """
    root = Path(folder)
    for kind in ("images", "labels"):
        for split in ("train", "val"):
            (root / kind / split).mkdir(parents=True, exist_ok=True)

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, split, content, lines in zip(*(batch.column(c).to_pylist() for c in ("key", "split", "content", "lines")), strict=True):
                _put(root / "images" / split / f"sample_{key}.{suffix}", content)
                _put(root / "labels" / split / f"sample_{key}.txt", "\n".join(lines or []).encode())
            yield pa.RecordBatch.from_arrays([batch.column("split")], names=["split"])

    whole = rows.where("key IS NOT NULL AND content IS NOT NULL").select(F.col("key").cast("string").alias("key"), dataset_split(F.col("key"), folds).alias("split"), "content", "lines")
    done = whole.mapInArrow(written, "split string").groupBy("split").agg(F.count("*").alias("images")).collect()  # two rows at most
    names = "".join(f"  {i}: {c}\n" for i, c in enumerate(dims.CLASSES))
    _put(root / "data.yaml", f"path: {root.resolve().as_posix()}\ntrain: images/train\nval: images/val\n\nnames:\n{names}".encode())
    return rows.sparkSession.createDataFrame([tuple(r) for r in done], "split string, images long")


def response(status: Column, message: Column, data: Column) -> Column:
    """The envelope of an answer."""
    return F.struct(status.alias("status"), message.alias("message"), data.alias("data"))
