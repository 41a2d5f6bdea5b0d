"""A data source of files' first bytes: what a listing needs of files that may be large."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME, SCHEMA = "file_heads", "path string, modified timestamp, size long, head binary"
#: Folders that one task lists and reads.
FOLDERS = 64


class Folders(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class HeadReader(DataSourceReader):
    """Folders are found on the driver, a level at a time; their files are listed and read in tasks, ``bytes`` of each."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.suffix = options["path"], options.get("suffix", "")
        self.depth, self.bytes = int(options.get("depth", 3)), int(options.get("bytes", 1024))
        self.skipped = set(filter(None, options.get("skipped", "").split(",")))

    def _store(self) -> tuple[fs.FileSystem, str, str]:
        """(file system, the root's path in it, what stands before paths in it): any that Arrow knows."""
        if "://" not in self.root and not self.root.startswith("file:"):
            return fs.LocalFileSystem(), self.root.rstrip("/"), ""
        uri = self.root if "://" in self.root else "file://" + self.root.removeprefix("file:")
        store, path = fs.FileSystem.from_uri(uri)
        return store, path.rstrip("/"), uri[: len(uri.rstrip("/")) - len(path.rstrip("/"))]

    def partitions(self) -> list[InputPartition]:
        store, top, _ = self._store()
        found = front = [top]
        for _ in range(self.depth):
            inside = [i for p in front for i in store.get_file_info(fs.FileSelector(p)) if i.type == fs.FileType.Directory]
            front = sorted(i.path for i in inside if not i.base_name.startswith(".") and i.base_name not in self.skipped)
            found = found + front
        return [Folders(found[i : i + FOLDERS]) for i in range(0, len(found), FOLDERS)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        store, _, before = self._store()
        for folder in partition.paths:
            for i in store.get_file_info(fs.FileSelector(folder)):
                if i.type == fs.FileType.File and i.base_name.endswith(self.suffix):
                    with store.open_input_file(i.path) as f:
                        head = f.read(self.bytes)
                    yield before + i.path, datetime.fromtimestamp(i.mtime_ns / 1e9, UTC), i.size, head


class Heads(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadReader:
        return HeadReader(dict(self.options))


def read_heads(spark: SparkSession, root: str, **options):
    """path, modified, size and head of the files below a folder, ``depth`` (3) folders deep, without hidden ones and those named in ``skipped``; ``bytes`` (1,024) are read of each."""
    spark.dataSource.register(Heads)
    return spark.read.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(root)
