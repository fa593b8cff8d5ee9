"""Writing word lists as files from the executors, as a data source: `df.write.format(LIST_SINK).mode("overwrite").save(path)`.

df has the rows as text, in a column `row`, in the order that they are to have in the files:

* with a column `target`, each target gets a file of its own, its rows next to each other in one task
  (repartition by target, sort within); a null row makes a file that has a header only;
* otherwise the partitions in order are one list.  It becomes a folder of part files, or with the option
  `single` one file, for which the parts, of which only the first has the header, are joined byte by byte.

Tasks write under names of their own; files get their real names when all tasks are done, and what a
failed job wrote is deleted.  `path` is only the folder or file of a list without targets.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from glossaria.sources import wordlist_csv
from glossaria.sources.files import _system

LIST_SINK = "glossaria_list"


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: (temporary name, real name, rows); the real name is the part's number for lists without targets."""

    files: list[tuple[str, str, int]] = field(default_factory=list)


class ListSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return LIST_SINK

    def writer(self, schema: StructType, overwrite: bool) -> ListWriter:
        if not overwrite:
            raise ValueError("lists are written whole: use mode('overwrite')")
        return ListWriter(self.options.get("path", ""), self.options.get("single", "false").lower() == "true", "target" in schema.names)


class ListWriter(DataSourceArrowWriter):
    def __init__(self, path: str, single: bool, targets: bool):
        self.path, self.single, self.targets, self.run = path, single, targets, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, out, now, n = Written(), None, None, 0
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()

        def close():
            out.close()
            done.files.append((name, now, n))

        for b in iterator:
            rows = b["row"].to_pylist()
            for target, row in zip(b["target"].to_pylist() if self.targets else [f"{part:09d}"] * len(rows), rows):
                if target != now:
                    if out:
                        close()
                    now, n = target, 0
                    name = f"{target}.{self.run}-{attempt}.tmp" if self.targets else f"{self.path}.{self.run}/{target}-{attempt}"
                    fs, at = _system(name)
                    fs.create_dir(os.path.dirname(at), recursive=True)
                    out = fs.open_output_stream(at)
                    if self.targets or not self.single:
                        out.write(f"{wordlist_csv.HEADER}\n".encode())
                if row is not None:
                    out.write(f"{row}\n".encode())
                    n += 1
        if out:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        written = [f for m in messages if m for f in m.files]
        if self.targets:
            for name, target, _ in written:
                _move(name, target)
            return
        parts = sorted(written, key=lambda f: f[1])
        fs, at = _system(self.path)
        if self.single:
            fs.create_dir(os.path.dirname(at), recursive=True)
            with fs.open_output_stream(f"{at}.{self.run}.tmp") as out:
                out.write(f"{wordlist_csv.HEADER}\n".encode())
                for name, _, _ in parts:
                    with fs.open_input_stream(_system(name)[1]) as f:
                        while piece := f.read(8 << 20):
                            out.write(piece)
            _move(f"{self.path}.{self.run}.tmp", self.path)
        else:
            if fs.get_file_info(at).type == pafs.FileType.Directory:
                fs.delete_dir(at)
            fs.create_dir(at, recursive=True)
            for k, (name, _, _) in enumerate(parts):
                _move(name, f"{self.path}/part-{k:05d}.csv")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for name, _, _ in m.files if m and self.targets else ():
                fs, at = _system(name)
                fs.delete_file(at)
        self._clear()

    def _clear(self) -> None:
        fs, at = _system(f"{self.path}.{self.run}")
        if self.path and fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir(at)


def _move(name: str, target: str) -> None:
    fs, at = _system(name)
    fs.move(at, _system(target)[1])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListSink)


def write_list(entries: DataFrame, path: str, order: str = "lemma", single: bool = False, parts: int | None = None) -> None:
    """entries(lemma, flags, ...) in the order of a column as one list: a folder of parts, or one file; by default as many parts as the shuffle finds right."""
    register(entries.sparkSession)
    dealt = entries.repartitionByRange(parts, order) if parts else entries.repartitionByRange(order)
    rows = dealt.sortWithinPartitions(order).select(wordlist_csv.csv_row(F.col("lemma"), F.col("flags")).alias("row"))
    rows.write.format(LIST_SINK).mode("overwrite").option("single", str(single)).save(path)


def write_lists(rows: DataFrame, *order: str) -> None:
    """rows(target, row, *order), each target's as a file of its own."""
    register(rows.sparkSession)
    rows.repartition("target").sortWithinPartitions("target", *order).select("target", "row").write.format(LIST_SINK).mode("overwrite").save("")
