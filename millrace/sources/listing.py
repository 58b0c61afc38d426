"""Listing of real files below chosen paths, folder by folder on the executors.

Each level of folders is a table; its folders are listed by tasks, which give files and the folders of the next level. So the driver holds no list, and the
number of rounds is the depth of the tree. Local (and mounted) paths are read with links told apart; paths with another scheme through
``pyarrow.fs``, whose stores have no links.

Rules: a chosen file counts even if it is hidden, a chosen link never does; in folders hidden names, links and packages (``ingest.PACKAGES``) are passed
over with all below them; a chosen package is passed over too. What cannot be read comes as a row with its problem and stops nothing.
"""

from __future__ import annotations

import os
import re
import stat
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from ..tables import written
from .ingest import PACKAGES

_ROWS = "path string, kind string, length long, modified double, problem string"
_PACKAGE = re.compile(rf"\.(?:{PACKAGES})$", re.IGNORECASE)


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    return path if not parts.scheme else parts.path if parts.scheme == "file" else None


def _entry(path: str, mode: int, length: int, modified: float, chosen: bool) -> tuple | None:
    """The row of one file or folder; None if the rules pass over it."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if stat.S_ISLNK(mode) or not chosen and name.startswith("."):
        return None
    if stat.S_ISDIR(mode):
        return None if _PACKAGE.search(name) else (path.rstrip("/") or "/", "folder", None, None, None)
    if stat.S_ISREG(mode):
        return (path, "file", length, modified, None)
    return (path, "other", None, None, "neither a file nor a folder") if chosen else None


def looked_up(path: str) -> list[tuple]:
    """The row of a chosen path."""
    try:
        if (own := _local(path)) is not None:
            own = os.path.abspath(own)
            of = os.lstat(own)
            found = _entry(own, of.st_mode, of.st_size, of.st_mtime, True)
        else:
            from pyarrow import fs

            store, inside = fs.FileSystem.from_uri(path)
            found = _of_store(store.get_file_info(inside), path, True)
    except (OSError, pa.ArrowException) as e:
        return [(path, "unread", None, None, f"{type(e).__name__}: {e}")]
    return [found] if found else []


def _of_store(info, path: str, chosen: bool) -> tuple | None:
    from pyarrow import fs

    if info.type == fs.FileType.NotFound:
        return (path, "unread", None, None, "not found")
    mode = {fs.FileType.File: stat.S_IFREG, fs.FileType.Directory: stat.S_IFDIR}.get(info.type, 0)
    return _entry(path, mode, info.size, info.mtime_ns / 1e9 if info.mtime_ns else None, chosen)


def listed(folder: str) -> list[tuple]:
    """Rows of what lies in a folder."""
    rows = []
    try:
        if (own := _local(folder)) is not None:
            with os.scandir(own) as entries:
                for e in entries:
                    of = e.stat(follow_symlinks=False)
                    rows.append(_entry(f"{own.rstrip('/')}/{e.name}", of.st_mode, of.st_size, of.st_mtime, False))
        else:
            from pyarrow import fs

            store, inside = fs.FileSystem.from_uri(folder)
            for info in store.get_file_info(fs.FileSelector(inside)):
                rows.append(_of_store(info, f"{folder.rstrip('/')}/{info.base_name}", False))
    except (OSError, pa.ArrowException) as e:
        rows.append((folder, "unread", None, None, f"{type(e).__name__}: {e}"))
    return [r for r in rows if r]


def _each(paths: DataFrame, look) -> DataFrame:
    """The rows that ``look`` gives for each of the paths, which are dealt over tasks."""
    shipped(paths.sparkSession)
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("modified", pa.float64()), ("problem", pa.string())])

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = look(path)
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*rows[at : at + 10_000]))], schema=schema)

    return paths.select("path").repartition("path").mapInArrow(run, _ROWS)


def files(spark: SparkSession, chosen: list[str] | DataFrame) -> DataFrame:
    """path, length, modified, problem of all files that the chosen paths (a list, or a table with ``path``) stand for: each path once, ordered by path."""
    paths = chosen.select("path") if isinstance(chosen, DataFrame) else spark.createDataFrame([(p,) for p in chosen], "path string")
    level = written(_each(paths.distinct(), looked_up), "chosen")
    found = level.where("kind <> 'folder'")
    folders = level.where("kind = 'folder'").select("path").distinct()
    while not folders.isEmpty():
        level = written(_each(folders, listed), "folders")
        found = found.unionByName(level.where("kind <> 'folder'"))
        folders = level.where("kind = 'folder'").select("path")
    first = found.groupBy("path").agg(F.max("length").alias("length"), F.max("modified").alias("modified"), F.max("problem").alias("problem"))
    return first.select("path", "length", F.timestamp_seconds("modified").alias("modified"), "problem").orderBy("path")
