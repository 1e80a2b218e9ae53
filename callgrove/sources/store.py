"""A folder of small documents on any file system that Spark reaches: run records, summaries, digests."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import cache

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="callgrove-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that driver and executors share")
    return (found or _own_dir()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> Store:
    """A new folder of the shared one, removed at interpreter exit."""
    store = Store(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    atexit.register(store.remove)
    return store


class Store:
    """Paths are relative to ``base``, which may be local or on shared storage."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _at(self, name: str):
        where = self._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
        return where.getFileSystem(self._conf), where

    def exists(self, name: str) -> bool:
        files, where = self._at(name)
        return files.exists(where)

    def names(self, pattern: str) -> list[str]:
        """Of the files that match, sorted."""
        files, where = self._at(pattern)
        return sorted(status.getPath().getName() for status in files.globStatus(where) or [])

    def read(self, name: str) -> bytes:
        files, where = self._at(name)
        stream = files.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, content: bytes) -> None:
        """Beside it first, then renamed over it: a reader sees the old document or the new one."""
        self._renamed(name, content, replace=True)

    def publish(self, name: str, content: bytes) -> None:
        """As ``write``, but a document that is there stays, and that is an error."""
        if self.exists(name):
            raise ValueError(f"{self.path(name)} is there already")
        try:
            self._renamed(name, content, replace=False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error):
                raise ValueError(f"{self.path(name)} is there already") from error
            raise

    def _renamed(self, name: str, content: bytes, *, replace: bool) -> None:
        self._filled(name, lambda stream: stream.write(content), replace=replace)

    def _filled(self, name: str, fill: Callable[[JavaObject], None], *, replace: bool) -> None:
        folder, _, last = name.rpartition("/")
        files, draft = self._at(f"{folder}/.{last}.{uuid.uuid4().hex[:8]}".lstrip("/"))
        stream = files.create(draft, True)
        try:
            fill(stream)
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(options, 1)
        kinds[0] = options.OVERWRITE if replace else options.NONE
        _, final = self._at(name)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else files.getUri(), self._conf).rename(files.makeQualified(draft), files.makeQualified(final), kinds)

    def remove(self) -> None:
        """The whole folder; nothing where the session is gone."""
        with suppress(Exception):
            files, where = self._at("")
            files.delete(where, True)

    def document(self, name: str):
        return json.loads(self.read(name))

    def put(self, name: str, value: object) -> None:
        self.write(name, (json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode())

    def sha256(self, *names: str) -> str:
        """Of the files one after another. Read in blocks by the JVM, so that files of any size have their digest made without being held."""
        tools = self._jvm.org.apache.commons.codec.digest.DigestUtils
        digest = tools.getSha256Digest()
        for name in names:
            files, where = self._at(name)
            stream = files.open(where)
            try:
                tools.updateDigest(digest, stream)
            finally:
                stream.close()
        return bytes(digest.digest()).hex()

    def concatenate(self, paths: list[str], name: str) -> str:
        """One file of several (whole paths, on any file system), copied in blocks by the JVM; returns its SHA-256."""
        digest = self._jvm.java.security.MessageDigest.getInstance("SHA-256")

        def fill(stream) -> None:
            out = self._jvm.java.security.DigestOutputStream(stream, digest)
            for path in paths:
                where = self._jvm.org.apache.hadoop.fs.Path(path)
                part = where.getFileSystem(self._conf).open(where)
                try:
                    self._jvm.org.apache.commons.io.IOUtils.copyLarge(part, out)
                finally:
                    part.close()

        self._filled(name, fill, replace=True)
        return bytes(digest.digest()).hex()

    def size(self, name: str) -> tuple[str, int] | None:
        """A file's whole path and its bytes; None if there is no such file."""
        files, where = self._at(name)
        if not files.exists(where) or (status := files.getFileStatus(where)).isDirectory():
            return None
        return status.getPath().toString(), status.getLen()

    def pin(self, name: str, value: object) -> None:
        """Keeps a document that must not change: written if it isn't there, else compared."""
        if not self.exists(name):
            self.put(name, value)
        elif self.document(name) != value:
            raise ValueError(f"{self.path(name)} belongs to a different run; use another folder")
