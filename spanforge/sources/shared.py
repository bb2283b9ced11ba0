"""The folder that driver and executors share, and small files in it or in any other store that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, as in tests, one is made where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Store:
    """Names, renames and small texts below paths of any file system that Spark has."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """Whether old now has the new name; not if that is taken."""
        fs, p = self._at(old)
        to = self.jvm.org.apache.hadoop.fs.Path(new)
        if fs.exists(to):
            return False
        fs.mkdirs(to.getParent())
        return fs.rename(p, to)

    def write_once(self, path: str, text: str) -> bool:
        """Whether a file of this name was made, whole and by this call alone."""
        fs, p = self._at(f"{path}.{uuid.uuid4().hex}.new")
        stream = fs.create(p)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        done = self.rename(p.toString(), path)
        if not done:
            fs.delete(p, False)
        return done

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
