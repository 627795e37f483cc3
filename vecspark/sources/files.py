"""Small files and folders in whatever file system Spark reaches."""

from __future__ import annotations

import json
import os
import re
import tempfile
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from vecspark.types import InvalidConfig


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def folders(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)) if s.isDirectory())

    def files(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)) if not s.isDirectory())

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def make(self, name: str) -> bool:
        return self._fs.mkdirs(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))

    def read_json(self, name: str) -> Any:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, name: str, value: Any) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def create_json(self, name: str, value: Any) -> bool:
        """Makes the file with its whole content; False if there is one of that name."""
        draft = f"{name}.{os.urandom(8).hex()}"
        self.write_json(draft, value)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if "://" in self.root else self._fs.getUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(self._path(draft)), self._fs.makeQualified(self._path(name)), none)
        except Py4JJavaError:
            self.delete(draft)
            if self.exists(name):
                return False
            raise
        return True


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the cluster's shared one; only a local session without one has a temporary folder instead."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{name}-{os.urandom(8).hex()}"
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix=f"{name}-")
    raise InvalidConfig("a cluster has to name a folder that all its machines share in spark.checkpoint.dir")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as files in the shared checkpoint folder, so that what is read twice is the same both times."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()
