"""A Python data source `repo`: every regular file below a root that the rules let through, dotfiles included.

    spark.dataSource.register(RepoSource)
    spark.read.format("repo").option("path", root).load()

Paths are pruned on the driver before any file is read: blocklist (suffix, pattern, size) and ignore files.
Files are dealt to partitions by size. Built-in readers skip names that begin with . or _, so they won't do.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths as P
from ..functions import text as X

PARTITION_BYTES, PARTITION_FILES = 32 * 1024 * 1024, 2_000


@dataclass
class _Files(InputPartition):
    files: list


class _Reader(DataSourceReader):
    def __init__(self, root: str, max_bytes: int, extra: list[str]):
        self.root, self.max_bytes, self.extra = os.path.abspath(root), max_bytes, extra

    def kept(self) -> list[tuple[str, int]]:
        return sorted(visible(self.root, P.Blocklist(self.extra, self.max_bytes)))

    def partitions(self):
        out, size = [[]], 0
        for path, n in self.kept():
            if out[-1] and (size + n > PARTITION_BYTES or len(out[-1]) >= PARTITION_FILES):
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [_Files(x) for x in out]

    def read(self, partition):
        for path in partition.files:
            full = os.path.join(self.root, path)
            try:
                with open(full, "rb") as f:
                    content = f.read()
                changed = datetime.fromtimestamp(os.path.getmtime(full), timezone.utc)
            except OSError:
                continue  # gone or unreadable since it was listed: skipped, as any file that can't be read
            yield (path, full, bytearray(content), changed)


class RepoSource(DataSource):
    @classmethod
    def name(cls):
        return "repo"

    def schema(self):
        return "path string, absolute_path string, content binary, modified_at timestamp"

    def reader(self, schema):
        extra = [x for x in self.options.get("never_index", "").split("\n") if x]
        return _Reader(self.options["path"], int(self.options.get("max_bytes", 2 * 1024 * 1024)), extra)


def ignore_rules(root: str) -> P.IgnoreRules:
    """The .gitignore files of a tree by folder, those under .git left out."""
    found = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d != ".git"]
        if ".gitignore" in names:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                found[os.path.relpath(folder, root).replace(os.sep, "/").removeprefix(".")] = f.read()
    return P.IgnoreRules(found)


def visible(root: str, blocklist: P.Blocklist):
    """(relative path, size) of files to read."""
    ignore = ignore_rules(root)
    for folder, dirs, names in os.walk(root):
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        base = "" if base == "." else base + "/"
        dirs[:] = [d for d in dirs if blocklist.allowed(f"{base}{d}/x") and not ignore.ignored(f"{base}{d}/")]
        for name in names:
            full = os.path.join(folder, name)
            if os.path.isfile(full) and not os.path.islink(full):
                size = os.path.getsize(full)
                if blocklist.allowed(base + name, size) and not ignore.ignored(base + name):
                    yield base + name, size


def scan(spark: SparkSession, root: str, max_bytes: int = 2 * 1024 * 1024, never_index: list[str] | None = None) -> DataFrame:
    """The files table with `source`: what is read of a tree, hashed and measured."""
    spark.dataSource.register(RepoSource)
    raw = spark.read.format("repo").option("path", root).option("max_bytes", str(max_bytes)).option("never_index", "\n".join(never_index or [])).load()
    source = X.normalize_source(F.col("content"))
    return raw.select(
        X.file_id(F.col("path")).alias("id"), "path", "absolute_path", P.language_of(F.col("path")).alias("language"), F.length("content").cast("long").alias("size_bytes"),
        X.line_count(source).alias("line_count"), F.md5("content").alias("hash"), "modified_at", source.alias("source"),
    )
