"""``spark.read.format("filetree").load(root)``: metadata of a file tree, content unread; ``readStream`` gives what is new or changed.

The driver lists some folders from the top (``LISTED``), so that there are parts enough, and of each at most ``TOGETHER`` entries: a folder
with more is ``SLICES`` parts, whose executors each take the entries of their share of name hashes. Other parts are a folder that
an executor walks, or up to ``TOGETHER`` entries. So the tree must be mounted on both. Directories that are links, placeholders or
mount points of other devices are leaves with an error row; file links are listed and marked, never followed. An
unreadable directory is an error row, not a silent gap.

Filters on ``path`` (equal to, starts with, doesn't start with) are pushed into the walk: folders that can't hold a wanted path aren't
entered. ``register`` sets ``spark.sql.python.filterPushdown.enabled`` for that. The option ``maxDepth`` makes a folder
below that many levels an error row.

A stream's offset is a time: a batch has the files whose inode changed after the last one's. ``settle`` seconds (1 by default) are
left to the clock, which may lag; removed files don't show.
"""

import os
import socket
import stat
import time
import zlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, Not, StringStartsWith
from pyspark.sql.types import StructType

from syncsift.functions import placeholders
from syncsift.operators.inventory import SIDECAR
from syncsift.schema import INVENTORY, TICKS_AT_EPOCH


#: Folders that the driver lists at most, entries of a folder that it looks at, or of a part, at most, and parts of a larger folder.
LISTED, TOGETHER, SLICES = 64, 1000, 32


class _Part(InputPartition):
    def __init__(self, paths: list[str], slice_: int | None = None, since: int | None = None, until: int | None = None):
        super().__init__(paths)
        self.paths, self.slice_, self.since, self.until = paths, slice_, since, until

    def takes(self, name: str) -> bool:
        return self.slice_ is None or zlib.crc32(os.fsencode(name)) % SLICES == self.slice_


def _untouchable(s: os.stat_result) -> bool:
    """The attributes of a placeholder, where the system has them."""
    return bool(getattr(s, "st_file_attributes", 0) & sum(b for _, b in placeholders.BITS))


class _Walk:
    """The walk that batches and streams share."""

    def __init__(self, root: str, volume: str | None, max_depth: int | None = None):
        self.root, self.volume, self.max_depth = os.path.abspath(root), volume or socket.gethostname(), max_depth
        self.within: list[str] = []  # what a wanted path begins with, all of it
        self.without: list[str] = []  # what it doesn't begin with

    def _depth(self, folder: str) -> int:
        """Levels of the files in a folder: 1 in the root."""
        return os.path.relpath(folder, self.root).count(os.sep) + (2 if folder != self.root else 1)

    def _entered(self, folder: str) -> bool:
        """Whether a wanted path may lie below."""
        below = folder.rstrip("/") + "/"
        return all(below.startswith(w) or w.startswith(below) for w in self.within) and not any(below.startswith(w) for w in self.without)

    def _wanted(self, path: str) -> bool:
        return all(path.startswith(w) for w in self.within) and not any(path.startswith(w) for w in self.without)

    def parts(self, since: int | None = None, until: int | None = None) -> list[InputPartition]:
        device = os.lstat(self.root).st_dev
        todo, single, large, listed = deque([self.root]), [], [], 0
        while todo and listed < LISTED:
            path, listed = todo.popleft(), listed + 1
            found, folders = [], []
            try:
                with os.scandir(path) as entries:
                    for e in entries:
                        if len(found) == TOGETHER:
                            large.append(path)
                            break
                        found.append(e.path)
                        if e.is_dir(follow_symlinks=False) and e.stat(follow_symlinks=False).st_dev == device and not _untouchable(e.stat(follow_symlinks=False)):
                            folders.append(e.path)
            except OSError:
                if path == self.root:
                    raise
                single.append(path)  # the executor that walks it says why
                continue
            if path in large[-1:]:
                continue  # its slices find its folders
            folders.sort(key=os.fsencode)
            if self.max_depth is not None and self._depth(path) >= self.max_depth:
                single += sorted(found, key=os.fsencode)  # the folders among them are refused where they are met
                continue
            todo += [f for f in folders if self._entered(f)]
            single += sorted(set(found).difference(folders), key=os.fsencode)
        span = (since, until)
        made = [_Part([p], None, *span) for p in todo] + [_Part(single[a : a + TOGETHER], None, *span) for a in range(0, len(single), TOGETHER)]
        made += [_Part([p], i, *span) for p in large for i in range(SLICES)]
        return made or [_Part([])]

    def _row(self, path: str, s: os.stat_result, error: str | None = None) -> tuple:
        link = stat.S_ISLNK(s.st_mode)
        attributes = getattr(s, "st_file_attributes", 0) | (0x400 if link else 0)
        return (path, s.st_size, s.st_mtime_ns // 100 + TICKS_AT_EPOCH, attributes, self.volume, str(s.st_ino), None, link, stat.S_ISDIR(s.st_mode), error)

    def rows(self, part: _Part) -> Iterator[tuple]:
        device = os.lstat(self.root).st_dev
        todo = part.paths[::-1]
        first = part.paths[0] if part.slice_ is not None else None
        while todo:
            path = todo.pop()
            try:
                s = os.lstat(path)
            except OSError as e:
                if self._wanted(path):
                    yield (path, 0, 0, 0, self.volume, "", None, False, False, str(e))
                continue
            new = part.since is None or part.since < s.st_ctime_ns <= part.until
            if stat.S_ISDIR(s.st_mode):
                if path != self.root and not self._entered(path):
                    continue
                why = self._refused(path, s, device)
                if why:
                    if new:
                        yield self._row(path, s, why)
                    continue
                try:
                    with os.scandir(path) as entries:
                        todo += [e.path for e in entries if path != first or part.takes(e.name)]
                except OSError as e:
                    if new and (path != first or part.slice_ == 0):
                        yield self._row(path, s, str(e))
            elif new and self._wanted(path):
                if stat.S_ISREG(s.st_mode) or (stat.S_ISLNK(s.st_mode) and not os.path.isdir(path)):
                    yield self._row(path, s)
                elif stat.S_ISLNK(s.st_mode):
                    yield self._row(path, s, "a link to a directory is not followed")

    def _refused(self, path: str, s: os.stat_result, device: int) -> str | None:
        if _untouchable(s):
            return "a placeholder folder is not entered"
        if s.st_dev != device:
            return "another device is not entered"
        if self.max_depth is not None and self._depth(path) > self.max_depth:
            return f"deeper than {self.max_depth} levels: not entered"
        return None


class FileTreeReader(_Walk, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name is the interface's
        """Takes what it can of path filters, and leaves the others to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith)) and tuple(f.attribute) == ("path",):
                self.within.append(f.value)
                if isinstance(f, EqualTo):
                    yield f  # the walk goes by beginnings
            elif isinstance(f, Not) and isinstance(f.child, StringStartsWith) and tuple(f.child.attribute) == ("path",):
                self.without.append(f.child.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.parts()

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from self.rows(partition)


class FileTreeStreamReader(_Walk, DataSourceStreamReader):
    settle = 1.0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed_ns": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"changed_ns": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.parts(start["changed_ns"], end["changed_ns"])

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from self.rows(partition)


class FileTreeSource(DataSource):
    """Options: path (the root), volume (an id for it; the host's name by default), maxDepth, and settle for a stream."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> StructType:
        return INVENTORY

    def _options(self) -> tuple:
        depth = self.options.get("maxDepth")
        return self.options["path"], self.options.get("volume"), int(depth) if depth else None

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileTreeReader(*self._options())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        made = FileTreeStreamReader(*self._options())
        made.settle = float(self.options.get("settle", made.settle))
        return made


def register(spark: SparkSession) -> None:
    """The source, and the setting that a source which takes filters needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTreeSource)


def sidecar_contents(spark: SparkSession, inventory: DataFrame) -> DataFrame:
    """(path, content) of the sidecars in an inventory, read on the executors."""
    @F.pandas_udf(T.StringType())
    def read(paths: pd.Series) -> pd.Series:
        def one(p):
            try:
                with open(p, "rb") as f:
                    return f.read(1 << 16).decode("utf-8", "replace")
            except OSError:
                return ""

        return paths.map(one)

    return inventory.where(F.col("path").endswith(SIDECAR)).select("path", read.asNondeterministic()("path").alias("content"))
