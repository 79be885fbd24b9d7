"""Published tables: versions that are whole, a pointer that moves in one step, readers of any session.

A version is a folder with one folder a table. Pointers are small files, numbered; the highest names the
current version. A publisher creates the next number and fails if it is there already, so of two that
started from one version only one gets through, and nobody sees half of a version.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another publisher was first."""


@dataclass
class Version:
    number: int
    folder: str


class Snapshots:
    """The versions below a folder that all sessions reach, through the file system that holds it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        path, fs = self._path("pointers")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getLen() and s.getPath().getName().isdigit()) if fs.exists(path) else []

    def at(self, number: int) -> Version:
        path, fs = self._path("pointers", str(number))
        stream = fs.open(path)
        try:
            return Version(number, stream.readUTF())
        finally:
            stream.close()

    def current(self) -> Version | None:
        found = self._pointers()
        return self.at(found[-1]) if found else None

    def read(self, table: str, version: Version | None = None) -> DataFrame:
        """A table of a version, of the current one if none is named; a reader keeps the version that it began with."""
        version = version or self.current()
        if version is None:
            raise LookupError(f"nothing is published below {self.root}")
        return self.spark.read.parquet(f"{self.root}/{version.folder}/{table}")

    def publish(self, tables: dict[str, DataFrame], expected: Version | None) -> Version:
        """Writes a version and points to it, if the current one is still `expected` (None: nothing is published).

        A write that fails leaves the pointer where it was; its folder is removed.
        """
        folder = self.folder()
        try:
            self.write(tables, folder)
            return self.point(folder, expected)
        except BaseException:
            self.drop(folder)
            raise

    def folder(self) -> str:
        return f"versions/{uuid.uuid4().hex}"

    def write(self, tables: dict[str, DataFrame], folder: str) -> str:
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        return f"{self.root}/{folder}"

    def drop(self, folder: str) -> None:
        path, fs = self._path(folder)
        fs.delete(path, True)

    def point(self, folder: str, expected: Version | None) -> Version:
        """Makes a written folder the version after `expected`. A publisher that dies between its claim and its pointer leaves the number taken: see freed()."""
        number = expected.number + 1 if expected else 1
        if self._pointers()[-1:] != ([expected.number] if expected else []):
            raise Conflict(f"version {number} of {self.root} is another's")
        claim, fs = self._path("pointers", f".{number}.claim")
        if not fs.createNewFile(claim):  # atomic: one publisher alone gets a number
            raise Conflict(f"version {number} of {self.root} is another's")
        unnamed, named = self._path("pointers", f"_{uuid.uuid4().hex}")[0], self._path("pointers", str(number))[0]
        stream = fs.create(unnamed, False)
        stream.writeUTF(folder)
        stream.close()
        if not fs.rename(unnamed, named):
            raise RuntimeError(f"can't name the pointer {number} of {self.root}")
        return Version(number, folder)

    def freed(self) -> None:
        """Gives up a number that a dead publisher claimed and never named; only to be called when none is at work."""
        found = self._pointers()
        path, fs = self._path("pointers", f".{(found[-1] if found else 0) + 1}.claim")
        fs.delete(path, False)

    def keep(self, versions: int) -> None:
        """Removes all but the newest versions, pointers first, so that none leads to what is gone."""
        for number in self._pointers()[:-versions]:
            old = self.at(number)
            for parts in (("pointers", str(number)), (old.folder,)):
                path, fs = self._path(*parts)
                fs.delete(path, True)


def pulled(store: Snapshots, table: str, rows: DataFrame, least: float = 0.5) -> tuple[Version | None, str]:
    """Publishes what a pull brought, unless it failed or shrank: then the last version stays. Gives the current version and what happened.

    A pull that raises, that brings nothing, or less than `least` of the rows that there are, is no list but an accident.
    """
    now = store.current()
    try:
        new = store.spark.read.schema(rows.schema).parquet(store.write({table: rows}, folder := store.folder()) + f"/{table}")
        n = new.count()
    except Exception as e:
        store.drop(folder)
        return now, f"failed: {type(e).__name__}"
    old = store.read(table, now).count() if now else 0
    if not n or n < least * old:
        store.drop(folder)
        return now, f"shrank: {n} of {old}"
    return store.point(folder, now), "published"
