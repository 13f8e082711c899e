"""A folder tree as a table: every file but the ignored, dot files and empty files too, in the order of a walk."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscope.functions.text import glob_pattern

IGNORE = (".git", "node_modules", "__MACOSX", ".Trash", ".svn", ".hg", ".DS_Store", "Thumbs.db", "desktop.ini", "~$*", "._*", "*.tmp")
SCHEMA = "ord bigint, abs string, path string, size bigint, content binary"


def walked(root: str, ignore: tuple[str, ...] = IGNORE, skip: tuple[str, ...] = ()) -> Iterator[tuple[str, str, int, str | None]]:
    """(absolute path, path below root, size, None) of each file, names of a folder in order, folders entered where they stand; (.., .., 0, reason) of what can't be read or is a link."""
    barred = [re.compile(glob_pattern(g).replace(r"\z", r"\Z")) for g in ignore]
    left_out = {os.path.abspath(s) for s in skip}

    def visit(folder: str) -> Iterator[tuple[str, str, int, str | None]]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: (e.name.casefold(), e.name))
        except OSError as x:
            yield folder, os.path.relpath(folder, root), 0, type(x).__name__
            return
        for e in entries:
            if any(b.match(e.name) for b in barred):
                continue
            below = os.path.relpath(e.path, root).replace(os.sep, "/")
            if e.is_symlink():
                yield e.path, below, 0, "symlink"
            elif e.is_dir():
                if os.path.abspath(e.path) not in left_out:
                    yield from visit(e.path)
            elif e.is_file():
                yield e.path, below, e.stat().st_size, None

    yield from visit(root)


class _Part(InputPartition):
    def __init__(self, files: list[tuple[int, str, str, int]]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    #: Bytes of the files of one partition.
    BYTES = 64 << 20

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.ignore = tuple(options["ignore"].split("|")) if "ignore" in options else IGNORE
        self.skip = tuple(options["skip"].split("|")) if options.get("skip") else ()
        self.limit = int(options["limit"]) if options.get("limit") else None

    def partitions(self) -> list[_Part]:
        parts: list[_Part] = []
        now: list[tuple[int, str, str, int]] = []
        size = n = 0
        for a, p, s, reason in walked(self.root, self.ignore, self.skip):
            if reason:
                continue
            if self.limit is not None and n >= self.limit:
                break
            now.append((n, a, p, s))
            size, n = size + s, n + 1
            if size >= self.BYTES or len(now) >= 1000:
                parts.append(_Part(now))
                now, size = [], 0
        return [*parts, _Part(now)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for n, a, p, s in partition.files:
            with open(a, "rb") as f:
                yield n, a, p, s, f.read()


class FolderSource(DataSource):
    """spark.read.format("folder").load(root); options ignore and skip (parted by |) and limit, the first files of the walk."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_folder(spark: SparkSession, root: str, ignore: tuple[str, ...] = IGNORE, skip: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """(ord, abs, path, size, content, sha256) of the files of a folder tree that all executors see."""
    spark.dataSource.register(FolderSource)
    r = spark.read.format("folder").option("ignore", "|".join(ignore))
    if skip:
        r = r.option("skip", "|".join(skip))
    if limit is not None:
        r = r.option("limit", str(limit))
    return r.load(root).withColumn("sha256", F.sha2("content", 256))


def skipped(root: str, ignore: tuple[str, ...] = IGNORE, skip: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(path, reason) of what a walk leaves out."""
    return [(p, r) for _, p, _, r in walked(root, ignore, skip) if r]
