"""Files as rows: assets read as base64, decoded contents written, names checked."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import decoded, inside


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """path, relative to `folder`, and content of all files below it."""
    base = "/" + folder.split("://")[-1].removeprefix("file:").strip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split("path", f"\\Q{base}\\E", 2), 2).alias("path"), "content")


def assets_as_base64(assets: DataFrame, name: str, folder: str) -> DataFrame:
    """Each asset with `data`, the base64 of the file at the path `name` below `folder`; empty where there is none."""
    files = contents(assets.sparkSession, folder).select(F.col("path").alias("__path"), F.base64("content").alias("__data"))
    return assets.join(files, assets[name] == files["__path"], "left").withColumn("data", F.coalesce("__data", F.lit(""))).drop("__path", "__data")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes `content` at the path `name` below `folder`, by tasks, in any file system that Arrow knows; returns name and bytes.

    Nothing is written before the result is used. A task that runs again writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files_, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{name}"
                files_.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with files_.open_output_stream(path) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return files.where("name IS NOT NULL AND content IS NOT NULL").select("name", "content").mapInArrow(run, "name string, bytes long")


def to_write(files: DataFrame, name: str, data: str) -> DataFrame:
    """name and content, the decoded bytes, of files whose name stays inside the folder they go to."""
    return files.where(inside(F.col(name))).select(F.col(name).alias("name"), decoded(F.col(data)).alias("content"))


def refused(files: DataFrame, name: str) -> DataFrame:
    return files.where(~F.coalesce(inside(F.col(name)), F.lit(False)))


def without_deleted(metadata: DataFrame, key: str, deleted: DataFrame) -> DataFrame:
    """Deleting a file twice is no error."""
    return metadata.join(deleted.select(key).distinct(), key, "left_anti")
