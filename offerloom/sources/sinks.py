"""Where tables go: partitioned exports, ordered files, JSON documents and versioned snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def export_sheets(df: DataFrame, folder: str, sheet: Column) -> None:
    """One folder of CSV files per sheet."""
    df.withColumn("sheet", sheet).write.mode("overwrite").partitionBy("sheet").option("header", True).csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


class Snapshots:
    """A table whose versions are folders; a pointer names the current one and moves last, so
    readers see a whole version or the one before. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/CURRENT")
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        jvm, path, fs = self._pointer()
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["version"]
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        version = self.current()
        return self.spark.read.parquet(f"{self.folder}/{version}") if version else None

    def commit(self, df: DataFrame) -> str:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{version}")
        jvm, path, fs = self._pointer()
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.CURRENT-{version}")
        out = fs.create(fresh, True)
        try:
            out.write(bytearray(json.dumps({"version": version}).encode()))
        finally:
            out.close()
        # One rename, so a reader sees the old pointer or the new one, never half of it.
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, path, over)
        return version
