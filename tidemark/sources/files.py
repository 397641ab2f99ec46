"""Files through Hadoop's FileSystem, so that a store can be wherever Spark can read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from tidemark.errors import CommitConflict, InvalidConfiguration, StorageIoError


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share and that goes when the driver ends: under ``spark.checkpoint.dir``, or a
    temporary one where that is unset and all is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidConfiguration("spark.checkpoint.dir is not set: it names the folder that the cluster's machines share")
        shared = tempfile.gettempdir()
    folder = f"{str(shared).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def ensure(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def list(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file that must not be there yet, whole and in one step: of two writers one gets ``CommitConflict``.

        Each kind of file system has its own such step: a hard link on local ones, where renaming replaces; a rename where
        that refuses to replace (HDFS); and on object stores, whose files appear when they are closed, a conditional put.
        """
        folder, _, leaf = name.rpartition("/")
        self.ensure(folder)
        # where the folder really is, as a view's files can be in any file system
        there = self._fs.resolvePath(self._path(folder)).toUri()
        if there.getScheme() == "file":
            self._link(f"{there.getPath()}/{leaf}", text)
        elif there.getScheme() == "hdfs":
            temporary = f"{name}.{uuid.uuid4().hex}.tmp"
            self._put(temporary, text)
            if not self._fs.rename(self._path(temporary), self._path(name)):
                self._fs.delete(self._path(temporary), False)
                raise CommitConflict(f"{name} is there already")
        else:
            try:
                self._put(name, text)
            except Exception as e:
                if self.exists(name):
                    raise CommitConflict(f"{name} is there already") from e
                raise

    def _put(self, name: str, text: str) -> None:
        builder = self._fs.createFile(self._path(name)).overwrite(False)
        stream = builder.opt("fs.option.create.conditional.overwrite", "true").build()
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    @staticmethod
    def _link(path: str, text: str) -> None:
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temporary, path)
        except FileExistsError as e:
            raise CommitConflict(f"{path} is there already") from e
        finally:
            os.remove(temporary)

    def modified(self, name: str) -> float:
        """When anything in a folder, or the folder itself, was last changed, in epoch seconds."""
        last = self._fs.getFileStatus(self._path(name)).getModificationTime()
        for s in self._fs.listStatus(self._path(name)):
            inner = s.getModificationTime()
            if s.isDirectory():
                inner = max([inner, *(x.getModificationTime() for x in self._fs.listStatus(s.getPath()))])
            last = max(last, inner)
        return last / 1000

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise StorageIoError(f"can't rename {old} to {new}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
