"""Small files on whatever storage Spark writes to, through its own file systems."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from ..session import checkpoint_dir

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def checked_name(name: str) -> str:
    """A name that can't leave the folder it is put in."""
    if not _NAME.fullmatch(name) or ".." in name:
        raise ValueError(f"not a plain name: {name!r}")
    return name


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{kind}/{uuid.uuid4().hex}"


class Storage:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm, self.folder = spark._jvm, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What lies directly in a folder, without marks of the writer."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(name))] if self.exists(name) else []
        return sorted(n for n in found if not n.startswith(("_", ".")))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, content: bytes) -> None:
        """The whole file or none: it gets its name when it is complete."""
        partial = f"{name}.{uuid.uuid4().hex}.partial"
        self._fs.mkdirs(self._path(name).getParent())
        stream = self._fs.create(self._path(partial), True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        self._fs.delete(self._path(name), False)
        if not self._fs.rename(self._path(partial), self._path(name)):
            raise OSError(f"{name} could not be written")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
