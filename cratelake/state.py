"""Tables that live from run to run, in versions that appear whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class StaleVersion(RuntimeError):
    """Another run has committed since this one began."""


class State:
    """Named tables below a folder of any store that Spark reads and writes.

    A run writes its tables to a folder of its own and at last a marker, which is created once and names
    that folder: until then readers see the version before, and of two runs that began at one version
    one commits. Tables that a run doesn't write stay as they were. What a failed run has
    left is seen by nobody and goes with ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version, self._tables = self._latest()

    def _markers(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _latest(self) -> tuple[int, dict[str, str]]:
        for version in self._markers():
            lines = self.spark.read.text(f"{self.root}/commits/{version:08}", wholetext=True).collect()
            if lines and len(lines[0][0]) == 32:  # else its writer broke off while it wrote the marker
                return version, self._manifest(lines[0][0])
        return 0, {}

    def _manifest(self, run: str) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.root}/data/{run}/manifest", wholetext=True).first()[0])

    def refresh(self) -> State:
        return State(self.spark, self.root)

    def read(self, table: str, schema: str) -> DataFrame:
        """A table as of this version; empty, of this schema, if no run has written it."""
        if table not in self._tables:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/data/{self._tables[table]}")

    def commit(self, **tables: DataFrame) -> State:
        """The state with these tables in place of their versions before; fails if another run was faster."""
        run = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.write.parquet(f"{self.root}/data/{run}/{name}")
        manifest = self._tables | {name: f"{run}/{name}" for name in tables}
        self._write(f"{self.root}/data/{run}/manifest", json.dumps(manifest))
        if self._latest()[0] != self.version:
            raise StaleVersion(f"version {self.version} isn't the latest any more")
        mark = max([0, *self._markers()]) + 1
        try:
            self._write(f"{self.root}/commits/{mark:08}", run)
        except Exception as e:
            if self._fs.exists(self._path(f"{self.root}/commits/{mark:08}")):
                raise StaleVersion(f"version {mark} was committed by another run") from e
            raise
        return self.refresh()

    def _write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), False)  # fails if it exists
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def vacuum(self) -> int:
        """Removes what this version doesn't read; returns how many folders went. No run may be under way."""
        kept, gone = {t.split("/")[0] for t in self._tables.values()}, 0
        folder = self._path(f"{self.root}/data")
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            name = status.getPath().getName()
            if name not in kept and name != self._run():
                self._fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def _run(self) -> str:
        """The run that wrote this version, whose manifest readers need."""
        return self.spark.read.text(f"{self.root}/commits/{self.version:08}", wholetext=True).first()[0] if self.version else ""
