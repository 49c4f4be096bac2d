"""Snapshots: versioned Parquet folders behind a pointer that moves last, and differences by content hash."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changes(scanned: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, status (new, unchanged, modified, deleted) of (key, hash) rows against the known ones."""
    both = scanned.select(key, F.col("hash").alias("_new")).join(known.select(key, F.col("hash").alias("_old")), key, "full")
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("modified")
    return both.select(key, status.alias("status"))


class SnapshotStore:
    """Named tables; a commit writes a new version of some and then creates the next numbered log file.

    Readers see the last committed version; a run that dies before it creates its file leaves the store as
    it was. A log file is created exclusively: of two writers of one number the second takes the next one,
    and keeps what the first has committed of other tables. A log file that can't be read is passed over.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *[p for p in parts if p]]))

    def _versions(self) -> list[int]:
        folder = self._path("_log")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read_log(self, version: int) -> dict[str, str] | None:
        stream = self._files.open(self._path("_log", f"{version:012d}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
            return found if isinstance(found, dict) else None
        except ValueError:
            return None
        finally:
            stream.close()

    def current(self) -> dict[str, str]:
        """Folder of each table in the last version."""
        for version in reversed(self._versions()):
            found = self._read_log(version)
            if found is not None:
                return found
        return {}

    def read(self, name: str, schema) -> DataFrame:
        """The table, or an empty one of this schema where none has been committed."""
        path = self.current().get(name)
        return self.spark.createDataFrame([], schema) if path is None else self.spark.read.schema(schema).parquet(path)

    def commit(self, tables: dict[str, DataFrame]) -> int:
        new = {}
        for name, df in tables.items():
            new[name] = self._path(name, uuid.uuid4().hex).toString()
            df.write.parquet(new[name])
        while True:
            version = max(self._versions(), default=0) + 1
            try:
                stream = self._files.create(self._path("_log", f"{version:012d}.json"), False)
            except Py4JJavaError as error:
                if "AlreadyExists" in error.java_exception.getClass().getName():
                    continue  # another writer has this number
                raise
            stream.write(bytearray(json.dumps(self.current() | new).encode()))
            stream.close()
            return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders of tables that none of the last `keep` versions names, and older log files; returns the number of folders."""
        versions = self._versions()
        used = {p for v in versions[-keep:] for p in (self._read_log(v) or {}).values()}
        gone = 0
        for name in {n for v in versions for n in (self._read_log(v) or {})}:
            for folder in self._files.listStatus(self._path(name)) if self._files.exists(self._path(name)) else []:
                if not any(folder.getPath().toString().endswith(u.removeprefix("file:")) for u in used):
                    self._files.delete(folder.getPath(), True)
                    gone += 1
        for v in versions[:-keep]:
            self._files.delete(self._path("_log", f"{v:012d}.json"), False)
        return gone

    def delete_rows(self, name: str, schema, gone: DataFrame, key: str) -> int:
        """Commit the table without the rows whose key is in `gone`; returns how many went."""
        rows = self.read(name, schema)
        dropped = rows.join(gone.select(key).distinct(), key, "left_semi").count()
        if dropped:
            self.commit({name: rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)})
        return dropped

    def upsert(self, name: str, schema, new: DataFrame, key: str) -> int:
        """Commit the table with the new rows in place of those of the same key."""
        return self.commit({name: self.replace_rows(name, schema, new, new, key)})

    def replace_rows(self, name: str, schema, gone: DataFrame, new: DataFrame, key: str) -> DataFrame:
        """The table without the rows whose key is in `gone`, and with the new ones: commit this to take effect."""
        return self.read(name, schema).join(gone.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)
