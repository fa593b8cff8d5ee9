"""Word list files of any size: one file is read by many tasks, with the rows, line numbers and errors of wordlist_csv.

A row ends at a line end before which the file has an even number of quotes, so a task that starts in
the middle of a file must know how many there are before.  Pass 1 counts quotes and line ends of each
range of bytes; their sums over the ranges before give every range its parity and line.  Pass 2 finds
the first row that begins in its range and reads on past the range's end until its last row is
complete.  Blank rows at a file's end, which don't count, may fill whole ranges: pass 1 also tells where
a file's last byte that is no line end is.

A row belongs to the range in which it begins, however long it is; a quote that is never closed makes
the rest of the file one row, as in wordlist_csv.  Empty files have no rows.
"""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.shared import frozen
from glossaria.sources import files, wordlist_csv

RANGE, ROWS = 8 << 20, 20_000
_QUOTE, _LF, _CR = 34, 10, 13


def ranges(paths: DataFrame, size: int = RANGE) -> DataFrame:
    """(file, start, stop, odd, lines, end): for paths(file) the ranges of each file, whether it has an odd number of quotes before and how many line ends, and where its content ends (past the file if a quote stays open)."""

    def sizes(batches):
        for b in batches:
            found = [files.size_of(f) for f in b["file"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["file"], pa.array(found, pa.int64())], ["file", "size"])

    def count(batches):
        for b in batches:
            for f, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                data = np.frombuffer(files.read_range(f, start, stop - start + 1), np.uint8)
                own, then = data[: stop - start], data[1 : stop - start + 1]
                ends = own == _LF
                ends[: len(then)] |= (own[: len(then)] == _CR) & (then == _LF)
                content = np.flatnonzero(~ends)
                row = [f], [start], [stop], [int((own == _QUOTE).sum())], [int((own == _LF).sum())], [start + int(content[-1]) + 1 if len(content) else 0]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.string()), *(pa.array(c, pa.int64()) for c in row[1:])], ["file", "start", "stop", "quotes", "ends", "content"])

    every = paths.select("file").distinct().mapInArrow(sizes, "file string, size long").where("size > 0")
    cut = every.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))).alias("start"), "size")
    cut = frozen(cut.select("file", "start", F.least(F.col("start") + size, F.col("size")).alias("stop")), "list-ranges")
    seen = frozen(cut.repartition(min(50_000, max(1, cut.count()))).mapInArrow(count, "file string, start long, stop long, quotes long, ends long, content long"), "list-quotes")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    all_ = seen.groupBy(F.col("file").alias("its_file")).agg(F.sum("quotes").alias("all_quotes"), F.max("content").alias("last"))
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = seen.select("file", "start", "stop", (upto("quotes") % 2 == 1).alias("odd"), upto("ends").alias("lines"))
    open_ = F.col("all_quotes") % 2 == 1
    return placed.join(all_, F.col("file") == F.col("its_file")).select("file", "start", "stop", "odd", "lines", F.when(open_, F.lit(2**62)).otherwise(F.col("last")).alias("end"))


def _row_ends(data: np.ndarray, odd: bool) -> np.ndarray:
    """Where line ends lie that end a row."""
    at = np.flatnonzero(data == _LF)
    quotes = np.searchsorted(np.flatnonzero(data == _QUOTE), at) + odd
    return at[quotes % 2 == 0]


def rows_of(path: str, start: int, stop: int, odd: bool, lines: int, end: int, step: int = RANGE) -> list[tuple[int, str]]:
    """(line, row) for the rows that begin in a range; the file's first row, the header, is left out."""
    data = np.frombuffer(files.read_range(path, start, stop - start), np.uint8)
    ends = _row_ends(data, odd)
    if start and not (not odd and files.read_range(path, start - 1, 1) == b"\n"):
        if not len(ends):
            return []
        first = int(ends[0]) + 1  # the row before this goes on into the range
    else:
        first = 0
    if first >= len(data) or start + first >= end:
        return []
    line = lines + 1 + int((data[:first] == _LF).sum())
    text = data.tobytes()[first:]
    ended = bool(len(ends)) and ends[-1] == len(data) - 1
    if ended:
        text = text[:-1]
    else:  # the last row goes on after the range
        odd, at = odd ^ bool((data == _QUOTE).sum() % 2), stop
        while not ended and (piece := files.read_range(path, at, step)):
            raw = np.frombuffer(piece, np.uint8)
            found = _row_ends(raw, odd)
            ended = bool(len(found))
            text += piece[: int(found[0])] if ended else piece
            odd, at = odd ^ bool((raw == _QUOTE).sum() % 2), at + len(piece)
    if end < start + first + len(text):
        text = text[: end - start - first]
    elif ended:
        text = text.removesuffix(b"\r")  # of a line end of two bytes
    whole = not start
    rows = wordlist_csv._rows((text.removeprefix(codecs.BOM_UTF8) if whole else text).decode("utf-8", "replace"), line, whole=False)
    return rows[1:] if whole else rows


def read(paths: DataFrame, size: int = RANGE) -> DataFrame:
    """wordlist_csv's (file, line, lemma, flags, error_kind, error) for paths(file), each file once."""
    found = frozen(ranges(paths, size), "list-parts")

    def run(batches):
        for b in batches:
            for f, *place in zip(*(c.to_pylist() for c in b.columns)):
                rows = rows_of(f, *place, step=size)
                for k in range(0, len(rows), ROWS):
                    yield wordlist_csv.batch_of([(f, *wordlist_csv.entry(*r)) for r in rows[k : k + ROWS]])

    return found.repartition(min(50_000, max(1, found.count()))).mapInArrow(run, wordlist_csv.SCHEMA)
