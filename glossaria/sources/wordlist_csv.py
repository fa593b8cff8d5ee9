"""The two-column word list file: strict reading with line numbers, and writing.

A header row is skipped unread.  A row continues over line ends inside quotes.  A row that ends with
a quoted field counts an empty field after it, and blank rows inside the file are errors; both are
part of the format.  Flags beyond 31 bits are errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = "lemma,flags"
# Fixed value: what trimming a field removes.
BLANKS = "\t\n\x0b\x0c\r \xa0                　﻿"
SCHEMA = "file string, line long, lemma string, flags int, error_kind string, error string"


class WordListError(ValueError):
    """A word list that can't be read."""


#: Rows that a task hands on at once.
ROWS = 20_000


def _each_row(text: str, first: int = 1, whole: bool = True) -> Iterator[tuple[int, str]]:
    """Logical rows with the number of their first line: lines are joined while a quote is open.  Blank rows at the end of a whole file don't count."""
    text = text.replace("\r\n", "\n")
    begins, line, n, begun, open_, blanks = 0, 0, first, first, False, []
    while line >= 0:
        end = text.find("\n", line)
        stop = len(text) if end < 0 else end
        open_ ^= text.count('"', line, stop) % 2 == 1
        if not open_ or end < 0:
            if whole and begins == stop:
                blanks.append(begun)
            else:
                yield from ((b, "") for b in blanks)
                blanks.clear()
                yield begun, text[begins:stop]
            begins, begun = stop + 1, n + 1
        line, n = end + 1 if end >= 0 else -1, n + 1


def _rows(text: str, first: int = 1, whole: bool = True) -> list[tuple[int, str]]:
    return list(_each_row(text, first, whole))


#: A field with the comma after it: quoted (quotes in it doubled, the closing one may be missing) or plain.
_FIELD = re.compile(r'(?:"(?P<quoted>(?:[^"]|"")*+)"?|(?P<plain>[^",][^,]*+|))(?P<comma>,?)')


def _fields(row: str) -> list[str]:
    """A row's fields.  After a comma, and after a quoted field, there is one more field if the row ends; a blank row has none."""
    out: list[str] = []
    m = _FIELD.match(row) if row else None
    while m:
        quoted = m["quoted"] is not None
        out.append(m["quoted"].replace('""', '"') if quoted else m["plain"])
        if m.end() == len(row):
            return out + [""] * (quoted or bool(m["comma"]))
        m = _FIELD.match(row, m.end())
    return out


Parsed = tuple[int, str | None, int | None, str | None, str | None]


def parse(text: str) -> Iterator[Parsed]:
    """(line, lemma, flags, error_kind, error) for each row after the header."""
    for line, row in islice(_each_row(text.removeprefix("﻿")), 1, None):
        yield entry(line, row)


def entry(line: int, row: str) -> Parsed:
    """What a row says, or why it is bad."""
    fields = _fields(row)
    lemma, flags = (f.strip(BLANKS) for f in (*fields, "", "")[:2])
    if len(fields) != 2:
        return line, None, None, "columns", f"CSV parse error at line {line}: expected 2 columns, got {len(fields)}"
    if not lemma:
        return line, None, None, "lemma", f"CSV parse error at line {line}: empty lemma"
    if not re.fullmatch("[0-9]+", flags) or int(flags) > 2**31 - 1:
        return line, None, None, "flags", f'CSV parse error at line {line}: flags must be a non-negative integer, got "{flags}"'
    return line, lemma.lower(), int(flags), None, None


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], ["file", "line", "lemma", "flags", "error_kind", "error"])


def read_lists(files: DataFrame) -> DataFrame:
    """(file, line, lemma, flags, error_kind, error) from files(file, content)."""

    def run(batches):
        for b in batches:
            rows = ((f, *r) for f, c in zip(b["file"].to_pylist(), b["content"]) for r in parse(c.as_py() or ""))
            while some := list(islice(rows, ROWS)):
                yield batch_of(some)

    return files.select("file", "content").mapInArrow(run, SCHEMA)


def checked(rows: DataFrame) -> DataFrame:
    """(file, line, lemma, flags) if no row is bad; otherwise an error that names the first bad row of the first file."""
    bad = rows.where(F.col("error").isNotNull()).agg(F.min(F.struct("file", "line", "error")).alias("bad")).first()["bad"]
    if bad is not None:
        raise WordListError(f"Error in {bad['file']}: {bad['error']}")
    return rows.select("file", "line", "lemma", "flags")


def csv_row(lemma, flags):
    """One row as text: quoted only if it holds a comma, a quote or a line feed."""
    return F.concat(F.when(lemma.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(lemma, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(lemma), F.lit(","), flags.cast("string"))


def lines(entries: DataFrame, order: str = "lemma") -> Iterator[str]:
    """A word list's lines, one partition at a time on the driver: for a terminal; list_sink writes files."""
    yield f"{HEADER}\n"
    for r in entries.orderBy(order).select(csv_row(F.col("lemma"), F.col("flags")).alias("row")).toLocalIterator():
        yield f"{r['row']}\n"


def to_csv(entries: DataFrame, order: str = "lemma") -> str:
    """A word list as one text, for a message: the list must fit on the driver."""
    return "".join(lines(entries, order))
