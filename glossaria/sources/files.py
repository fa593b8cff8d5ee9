"""Text files: a single file of any kind, or the .md and .txt files of a tree, hidden names and node_modules left out.

Spark's own file listing skips names that start with an underscore, so trees are listed by tasks of our
own, a level of folders at a time, and the executors read the bytes; the driver never holds the list.
Paths with a scheme (file, s3, hdfs, gs, abfs) go through Arrow's file systems, others are local.
"""

from __future__ import annotations

import os
import uuid
from datetime import datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from glossaria.shared import frozen

SUFFIXES = (".md", ".txt")


def arrow_name(at: str) -> str:
    """A path as Arrow's file systems know it."""
    scheme, mark, rest = at.partition("://")
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(arrow_name(path)) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _kind(path: str) -> pafs.FileType:
    fs, at = _system(path)
    kind = fs.get_file_info(at).type
    if kind == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or directory: {path}")
    if kind not in (pafs.FileType.File, pafs.FileType.Directory):
        raise ValueError(f"neither a file nor a directory: {path}")
    return kind


def _inside(folder: str) -> list[tuple[str, bool]]:
    """(path, whether it is a folder) of what is wanted directly in a folder; links to folders count as files of no kind."""
    fs, at = _system(folder)
    found = []
    for f in fs.get_file_info(pafs.FileSelector(at)):
        name = f.base_name
        if name.startswith(".") or name == "node_modules":
            continue
        path = f"{folder.rstrip('/')}/{name}"
        if f.type == pafs.FileType.Directory and not ("://" not in path and os.path.islink(path)):
            found.append((path, True))
        elif f.type == pafs.FileType.File and name.lower().endswith(SUFFIXES):
            found.append((path, False))
    return found


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file): the files to read, a written table; FileNotFoundError or ValueError if path is neither a file nor a folder.

    Folders are listed by the executors, those of a level in one job, so a tree costs a job for each
    level of it, and neither driver nor task holds more than one folder's names.
    """
    schema = "path string, folder boolean"
    if _kind(path) == pafs.FileType.File:
        return frozen(spark.createDataFrame([(path,)], "file string"), "listed")

    def run(batches):
        for b in batches:
            for folder in b["path"].to_pylist():
                found = _inside(folder)
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_())], ["path", "folder"])

    level, files, n = spark.createDataFrame([(path.rstrip("/") or "/", True)], schema), [], 1
    while n:
        level = frozen(level.where("folder").repartition(min(10_000, 1 + n // 32)).mapInArrow(run, schema), "listed")
        files.append(level.where("NOT folder").select(level["path"].alias("file")))
        n = level.where("folder").count()
    every = files[0]
    for f in files[1:]:
        every = every.unionAll(f)
    return every


def _content(path: str) -> bytes:
    fs, at = _system(path)
    with fs.open_input_stream(at) as f:
        return f.read()


def size_of(path: str) -> int:
    fs, at = _system(path)
    info = fs.get_file_info(at)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(f"no such file: {path}")
    return info.size


def read_range(path: str, start: int, size: int) -> bytes:
    fs, at = _system(path)
    with fs.open_input_file(at) as f:
        f.seek(start)
        return f.read(size)


def read_files(files: DataFrame) -> DataFrame:
    """(file, content) of files(file): UTF-8 without a byte order mark.  The paths must be readable where the executors run."""

    def run(batches):
        for b in batches:
            for p in b["file"].to_pylist():
                text = _content(p).decode("utf-8", "replace").removeprefix("\ufeff")
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.string()), pa.array([text], pa.string())], ["file", "content"])

    return files.select("file").repartition(min(10_000, max(1, files.count() // 16))).mapInArrow(run, "file string, content string")


def write_files(files: DataFrame) -> int:
    """Writes files(file, content) as UTF-8, each whole or not at all; how many there were."""

    def run(batches):
        for b in batches:
            for path, text in zip(b["file"].to_pylist(), b["content"].to_pylist()):
                fs, at = _system(path)
                fs.create_dir(os.path.dirname(at), recursive=True)
                name = f"{os.path.dirname(at)}/.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(name) as f:
                    f.write((text or "").encode())
                fs.move(name, at)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select("file", "content").mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0


def output_name(path: str) -> str:
    """Where a file's words go: beside it, the extension replaced."""
    return f"{os.path.splitext(path)[0]}.words.csv"


def export_name(at: datetime) -> str:
    return f"words-{at:%Y%m%d-%H%M}.csv"
