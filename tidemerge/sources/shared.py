"""Folders and small files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``. Only a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{root or tempfile.mkdtemp(prefix='tidemerge-')}/{name}-{uuid.uuid4().hex}"


class Files:
    """A few calls of Hadoop's file system, for files of a few rows that need a rename."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self.at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self.at(path)
        fs.delete(p, True)

    def names(self, folder: str) -> list[str]:
        p, fs = self.at(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> str:
        p, fs = self.at(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Written beside ``path`` and renamed to it once whole; it must not exist."""
        p, fs = self.at(path)
        beside, _ = self.at(f"{path}.part")
        stream = fs.create(beside, True)
        stream.write(text.encode())
        stream.hsync()
        stream.close()
        if fs.exists(p) or not fs.rename(beside, p):
            raise FileExistsError(path)

    def move(self, folder: str, to: str) -> None:
        """A folder, once whole, renamed; what stood at ``to`` goes."""
        p, fs = self.at(folder)
        target, _ = self.at(to)
        fs.mkdirs(target.getParent())
        fs.delete(target, True)
        if not fs.rename(p, target):
            raise OSError(f"{folder} can't be renamed to {to}")
