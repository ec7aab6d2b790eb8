"""Directory trees as a Spark data source: ``spark.read.format("file_inventory")``.

Each top-level folder is one partition. A folder is listed whole or not at
all; what can't be read becomes a row with an error kind and no size. True
links are not followed.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "root_path string, relative_path string, file_name string, size_bytes long, modified_ns long, depth int, volume_serial string, file_index string, "
    "hard_link_count int, allocated_size_bytes long, is_link boolean, status string, error_kind string, error_message string"
)
#: errno names to error kinds (fixed values).
KINDS = {"ENOENT": "FILE MISSING", "EACCES": "ACCESS DENIED", "EPERM": "ACCESS DENIED", "EISDIR": "NOT A FILE"}


def error_kind(error: OSError) -> str:
    import errno

    return KINDS.get(errno.errorcode.get(error.errno or 0, ""), "IO ERROR")


def ordered(names: list[str]) -> list[str]:
    return sorted(names, key=lambda n: (n.casefold(), n))


class Folder(InputPartition):
    def __init__(self, root: str, relative: str | None):
        self.root, self.relative = root, relative


def _record(root: str, relative: str) -> tuple:
    name = relative.rpartition("/")[2]
    try:
        s = os.lstat(os.path.join(root, relative))
    except OSError as e:
        return (root, relative, name, None, None, relative.count("/"), None, None, None, None, None, "inaccessible", error_kind(e), " ".join(str(e).split()))
    return (root, relative, name, s.st_size, s.st_mtime_ns, relative.count("/"), str(s.st_dev), str(s.st_ino), s.st_nlink, s.st_blocks * 512, stat.S_ISLNK(s.st_mode), "observed", None, None)


def walk(root: str, relative: str, deep: bool) -> Iterator[tuple]:
    """A folder's files, then those of its folders, each level by folded name."""
    where = os.path.join(root, relative) if relative else root
    try:
        with os.scandir(where) as found:
            kinds = {e.name: e.is_dir(follow_symlinks=False) for e in found}
    except OSError as e:
        yield (root, relative or ".", relative.rpartition("/")[2], None, None, relative.count("/"), None, None, None, None, None, "inaccessible", "DIRECTORY ACCESS ERROR", " ".join(str(e).split()))
        return
    below = lambda n: f"{relative}/{n}" if relative else n
    for name in ordered([n for n, folder in kinds.items() if not folder]):
        yield _record(root, below(name))
    if deep:
        for name in ordered([n for n, folder in kinds.items() if folder]):
            yield from walk(root, below(name), True)


class InventoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self) -> list[Folder]:
        try:
            with os.scandir(self.root) as found:
                folders = ordered([e.name for e in found if e.is_dir(follow_symlinks=False)])
        except OSError:
            folders = []
        return [Folder(self.root, None), *[Folder(self.root, f) for f in folders]]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if partition.relative is None:
            yield from walk(partition.root, "", False)
        else:
            yield from walk(partition.root, partition.relative, True)


class FileInventory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InventoryReader:
        return InventoryReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(FileInventory)


def hash_files(rows, window: int | None = None, chunk: int = 1 << 20):
    """(root_path, relative_path, bytes_read, digest, error_kind, error_message): files read in chunks, never whole."""
    import hashlib

    import pyarrow as pa

    def work(batches):
        for batch in batches:
            out = []
            for root, relative in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, n = hashlib.sha256(), 0
                try:
                    with open(os.path.join(root, relative), "rb") as f:
                        while data := f.read(chunk if window is None else min(chunk, window - n)):
                            h.update(data)
                            n += len(data)
                    out.append((root, relative, n, h.hexdigest().upper(), None, None))
                except OSError as e:
                    out.append((root, relative, None, None, error_kind(e), " ".join(str(e).split())))
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["root_path", "relative_path", "bytes_read", "digest", "error_kind", "error_message"])

    return rows.select("root_path", "relative_path").mapInArrow(work, "root_path string, relative_path string, bytes_read long, digest string, error_kind string, error_message string")
