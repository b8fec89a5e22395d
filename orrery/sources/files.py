"""Paths in any file system that Spark reaches: local folders, HDFS, object stores.

A folder is listed in one call, however many files it has.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

_STATUS = re.compile(r"path=(.*?); isDirectory=(true|false)(?:; length=(\d+))?.*?; modification_time=(\d+)")


@dataclass
class Status:
    """What a listing says of a path: times in seconds."""

    folder: bool
    size: int
    modified: float


def plain_path(uri: str) -> str:
    """A path without scheme and escapes, by which names from different sources are compared."""
    return unquote(urlparse(uri).path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", uri) else uri


class SharedPath:
    """A path, with the operations that the engine needs on it."""

    def __init__(self, spark: SparkSession, path: object, status: Status | None = None) -> None:
        self.spark, self.text, self.status = spark, str(path).rstrip("/") or "/", status

    # names
    def __str__(self) -> str:
        return self.text

    def __fspath__(self) -> str:
        return self.text

    def __repr__(self) -> str:
        return f"SharedPath({self.text!r})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, SharedPath) and self.text == other.text

    def __hash__(self) -> int:
        return hash(self.text)

    def __lt__(self, other: SharedPath) -> bool:
        return self.text < other.text

    def __truediv__(self, name: object) -> SharedPath:
        return SharedPath(self.spark, f"{self.text}/{name}")

    @property
    def name(self) -> str:
        return self.text.rsplit("/", 1)[-1]

    @property
    def stem(self) -> str:
        return self.name.rsplit(".", 1)[0] if "." in self.name[1:] else self.name

    @property
    def parent(self) -> SharedPath:
        return SharedPath(self.spark, self.text.rsplit("/", 1)[0] or "/")

    # the file system
    @property
    def _jvm(self):
        return self.spark._jvm

    @property
    def _path(self):
        return self._jvm.org.apache.hadoop.fs.Path(self.text)

    @property
    def _fs(self):
        return self._path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, statuses) -> Iterator[SharedPath]:
        for m in _STATUS.finditer(self._jvm.org.apache.commons.lang3.ArrayUtils.toString(statuses)):
            yield SharedPath(self.spark, f"{self.text}/{m[1].rsplit('/', 1)[-1]}", Status(m[2] == "true", int(m[3] or 0), int(m[4]) / 1000))

    def iterdir(self) -> list[SharedPath]:
        """What the folder holds, by name; nothing if it does not exist."""
        fs, path = self._fs, self._path
        return sorted(self._listed(fs.listStatus(path)), key=lambda p: p.name) if fs.exists(path) else []

    def glob(self, pattern: str) -> Iterator[SharedPath]:
        """What the folder holds under names of the pattern, itself only."""
        return (p for p in self.iterdir() if fnmatch.fnmatchcase(p.name, pattern))

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def is_dir(self) -> bool:
        return self.status.folder if self.status else self.exists() and self._fs.getFileStatus(self._path).isDirectory()

    def is_file(self) -> bool:
        return not self.status.folder if self.status else self.exists() and self._fs.getFileStatus(self._path).isFile()

    def size(self) -> int:
        return self.status.size if self.status else self._fs.getFileStatus(self._path).getLen()

    def modified(self) -> float:
        return self.status.modified if self.status else self._fs.getFileStatus(self._path).getModificationTime() / 1000

    def mkdir(self, parents: bool = True, exist_ok: bool = True) -> None:
        self._fs.mkdirs(self._path)

    def unlink(self) -> None:
        self._fs.delete(self._path, False)

    def remove_tree(self) -> None:
        self._fs.delete(self._path, True)

    def rename(self, target: SharedPath) -> None:
        self._fs.rename(self._path, target._path)

    def read_text(self) -> str:
        stream = self._fs.open(self._path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8-sig")
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        stream = self._fs.create(self._path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _beside(self, text: str) -> SharedPath:
        temp = self.parent / f".{self.name}.{uuid.uuid4().hex}.tmp"
        temp.write_text(text)
        return temp

    def replace_text(self, text: str) -> None:
        """Other contents at once: a reader sees the old ones or the new ones."""
        temp, fs = self._beside(text), self._jvm.org.apache.hadoop.fs
        kinds = getattr(fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.OVERWRITE
        fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp._path, self._path, options)

    def create_text(self, text: str) -> bool:
        """Writes the file, whole, unless it exists: of several writers in any process one gets True.

        By a hard link in a local folder, by a rename that does not overwrite elsewhere (atomic in HDFS;
        an object store without conditional writes cannot promise it).
        """
        self.parent.mkdir()
        temp = self._beside(text)
        try:
            if self._fs.getUri().getScheme() == "file":
                paths = self._jvm.java.nio.file.Paths
                none = self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)
                try:
                    self._jvm.java.nio.file.Files.createLink(paths.get(plain_path(self.text), none), paths.get(plain_path(temp.text), none))
                except Exception as e:
                    if "FileAlreadyExists" in str(e):
                        return False
                    raise
                return True
            return not self.exists() and bool(self._fs.rename(temp._path, self._path))
        finally:
            if temp.exists():
                temp.unlink()
