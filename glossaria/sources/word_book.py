"""The replies of a remote word book's paged list as a data source: `spark.read.format(WORD_BOOK).load(path)` gives (page, status, body).

Replies are stored as files `page-<number>.json`, numbered from 0 without gaps, each an object with
`status` and `body`.  A partition is a range of pages (option `pages_per_partition`, 100 by default), so
as many tasks read as there are ranges; the number of pages is found by looking for files at doubled
numbers, or given as the option `pages`.  Writing a table of (page, status, body) in that format stores
replies.  The network is never called.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from glossaria.sources.files import _system

WORD_BOOK = "glossaria_word_book"
SCHEMA = "page long, status int, body string"


def _page(path: str, n: int) -> tuple[pafs.FileSystem, str]:
    return _system(f"{path.rstrip('/')}/page-{n}.json")


def _is_there(path: str, n: int) -> bool:
    fs, at = _page(path, n)
    return fs.get_file_info(at).type == pafs.FileType.File


def n_pages(path: str) -> int:
    """The first number without a page."""
    most = 1
    while _is_there(path, most - 1):
        most *= 2
    least = most // 2
    while least < most - 1:  # there are `least` pages or more, and fewer than `most`
        middle = (least + most) // 2
        least, most = (middle, most) if _is_there(path, middle - 1) else (least, middle)
    return least


@dataclass
class Pages(InputPartition):
    first: int
    end: int


class WordBook(DataSource):
    @classmethod
    def name(cls) -> str:
        return WORD_BOOK

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options["path"], int(self.options.get("pages_per_partition", 100)), self.options.get("pages"))

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"])


class PageReader(DataSourceReader):
    def __init__(self, path: str, step: int, pages: str | None):
        self.path, self.step, self.pages = path, max(1, step), pages

    def partitions(self) -> list[Pages]:
        n = n_pages(self.path) if self.pages is None else int(self.pages)
        return [Pages(k, min(k + self.step, n)) for k in range(0, n, self.step)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for n in range(partition.first, partition.end):
            fs, at = _page(self.path, n)
            with fs.open_input_stream(at) as f:
                reply = json.loads(f.read())
            yield n, reply["status"], reply["body"]


class PageWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        for b in iterator:
            for n, status, body in zip(*(b[c].to_pylist() for c in ("page", "status", "body"))):
                fs, at = _page(self.path, n)
                fs.create_dir(os.path.dirname(at), recursive=True)
                name = f"{at}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(name) as f:
                    f.write(json.dumps({"status": status, "body": body}).encode())
                fs.move(name, at)  # a page is there whole or not at all, so a task may run twice
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WordBook)
