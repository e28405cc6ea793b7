"""Scanning a file system into entries.

The tree below the root is cut into parts: directories are opened from the top
until there are enough of them, and each part walks its directory. An id is the
inode number, with a mark of the device in the high bits where the device isn't
the root's. What is removed while it is read is left out.
"""

from __future__ import annotations

import base64
import json
import os
import stat
import time
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id long, parent_id long, name string, path string, type int, mode int, nlink long, uid long, gid long, blksize long, ino long, size long, blocks long, atime_sec long, atime_nsec int, btime_sec long, btime_nsec int, ctime_sec long, ctime_nsec int, mtime_sec long, mtime_nsec int, dev_major long, dev_minor long, rdev_major long, rdev_minor long, symlink string, xattrs map<string,string>, sync_time long"
#: Parts that a scan is cut into.
PARTS = 64
_INODE_BITS = 48


def identity(s: os.stat_result, home: int) -> int:
    """An id of an inode, for a root on device `home`."""
    if s.st_ino >> _INODE_BITS:
        raise ValueError(f"inode number {s.st_ino} is too large")
    return s.st_ino if s.st_dev == home else (zlib.crc32(str(s.st_dev).encode()) & 0x7FFF or 1) << _INODE_BITS | s.st_ino


def attributes(full: str) -> dict[str, str]:
    """Extended attributes as JSON texts; bytes that are no text in base64."""
    out = {}
    try:
        for name in os.listxattr(full, follow_symlinks=False):
            raw = os.getxattr(full, name, follow_symlinks=False)
            try:
                out[name] = json.dumps(raw.decode())
            except UnicodeDecodeError:
                out[name] = json.dumps(base64.b64encode(raw).decode())
    except OSError:
        pass
    return out


def entry(root: str, full: str, parent: int, home: int, now: int, xattrs: bool = True):
    """The row of a path, or None if it has gone."""
    try:
        s = os.lstat(full)
        link = os.readlink(full) if stat.S_ISLNK(s.st_mode) else None
    except OSError:
        return None
    shown = "/" + os.path.relpath(full, root) if full != root else "/"
    split = lambda ns: (ns // 10**9, ns % 10**9)
    born = split(int(s.st_birthtime * 10**9)) if hasattr(s, "st_birthtime") else (None, None)
    kind = stat.S_IFMT(s.st_mode)
    return (
        identity(s, home), parent, "" if full == root else os.path.basename(full), shown, kind, s.st_mode & ~kind & 0o7777, s.st_nlink, s.st_uid, s.st_gid, s.st_blksize, s.st_ino, s.st_size, s.st_blocks,
        *split(s.st_atime_ns), *born, *split(s.st_ctime_ns), *split(s.st_mtime_ns), os.major(s.st_dev), os.minor(s.st_dev), os.major(s.st_rdev), os.minor(s.st_rdev), link, attributes(full) if xattrs else {}, now,
    )


class Part(InputPartition):
    """Some directories to walk, or, not `deep`, some paths to read alone."""

    def __init__(self, paths: list[str], deep: bool):
        self.paths, self.deep = paths, deep


class ScanReader(DataSourceReader):
    def __init__(self, root: str, now: int, parts: int, xattrs: bool):
        self.root, self.now, self.parts, self.xattrs = root, now, parts, xattrs

    def partitions(self):
        alone, level = [self.root], [self.root]
        while level and len(level) < self.parts:
            below = []
            for folder in level:
                try:
                    with os.scandir(folder) as found:
                        for e in found:
                            (below if e.is_dir(follow_symlinks=False) else alone).append(e.path)
                except OSError:
                    continue
            level = below
            # Directories that are opened here are read alone, those of the last level are walked.
            if level and len(level) < self.parts:
                alone += level
        step = max(1, -(-len(alone) // self.parts))
        return [Part(alone[k : k + step], False) for k in range(0, len(alone), step)] + [Part([p], True) for p in level]

    def read(self, partition):
        root = self.root
        home = os.lstat(root).st_dev

        def row(full: str, folder: str):
            try:
                parent = 0 if full == root else identity(os.lstat(folder), home)
            except OSError:
                return None
            return entry(root, full, parent, home, self.now, self.xattrs)

        for path in partition.paths:
            made = row(path, os.path.dirname(path))
            if made is None:
                continue
            yield made
            if not partition.deep:
                continue
            for folder, dirs, files in os.walk(path):
                for name in (*dirs, *files):
                    made = row(os.path.join(folder, name), folder)
                    if made is not None:
                        yield made


class ScanSource(DataSource):
    """spark.read.format("entrywise_scan").option("path", root): metadata of every entry below root. Options: parts, now, xattrs."""

    @classmethod
    def name(cls):
        return "entrywise_scan"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        o = self.options
        return ScanReader(o["path"].rstrip("/") or "/", int(o.get("now", time.time())), int(o.get("parts", PARTS)), o.get("xattrs", "true") == "true")


def scan(spark: SparkSession, root: str, parts: int = PARTS, xattrs: bool = True) -> DataFrame:
    """One row for each entry below a folder that every executor sees under the same path."""
    spark.dataSource.register(ScanSource)
    return spark.read.format("entrywise_scan").option("path", root).option("parts", parts).option("xattrs", str(xattrs).lower()).load()
