"""python -m glossaria.cli extract PATH [-o OUT] | merge CSV CSV... [-o OUT] | --version"""

from __future__ import annotations

import argparse
import os
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria import __version__
from glossaria.operators import words
from glossaria.shared import frozen
from glossaria.sources import files, list_files, list_sink, wordlist_csv


def _targets(found: DataFrame, out: str | None) -> DataFrame:
    """(file, target): where each file's words go; of files with one target only the last is left."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["file"], pa.array([out or files.output_name(f) for f in b["file"].to_pylist()], pa.string())], ["file", "target"])

    return found.mapInArrow(run, "file string, target string").groupBy("target").agg(F.max("file").alias("file"))


def extract(spark: SparkSession, path: str, out: str | None) -> None:
    found = files.listed(spark, path)
    if out and not os.path.isfile(path):
        raise ValueError("-o needs a single file, not a directory")
    if found.isEmpty():
        print(f"no .md or .txt files under {path}", file=sys.stderr)
        return
    texts = files.read_files(found).withColumnRenamed("content", "text")
    entries = frozen(words.extract_entries(texts, "file", vocabulary=words.vocabulary(texts)), "extracted")
    rows = entries.select(F.col("file").alias("its_file"), "first_pos", wordlist_csv.csv_row(F.col("lemma"), F.col("flags")).alias("row"))
    targets = _targets(found, out)
    list_sink.write_lists(targets.join(rows, F.col("file") == F.col("its_file"), "left"), "first_pos")
    counts = targets.join(entries.groupBy(F.col("file").alias("its_file")).agg(F.count("*").alias("n")), F.col("file") == F.col("its_file"), "left")
    for r in counts.orderBy("file").toLocalIterator():  # a line for each file
        print(f"{r['file']} → {r['target']} ({r['n'] or 0} words)", file=sys.stderr)


def merge(spark: SparkSession, paths: list[str], out: str | None) -> None:
    if len(paths) < 2:
        raise ValueError("merge needs two files or more")
    for p in paths:
        if not os.path.isfile(p):
            raise FileNotFoundError(f"no such file: {p}")
    first = spark.createDataFrame([(p, k) for k, p in enumerate(dict.fromkeys(paths))], "its_file string, list_idx int")
    rows = wordlist_csv.checked(frozen(list_files.read(first.select(F.col("its_file").alias("file"))), "lists"))
    merged = words.merged_by_place(rows.join(first, F.col("file") == F.col("its_file")).select("lemma", "flags", "list_idx", F.col("line").alias("pos")))
    if not out:
        for line in wordlist_csv.lines(merged, "seen"):
            sys.stdout.write(line)
        return
    merged = frozen(merged, "merged")
    list_sink.write_list(merged, out, "seen", single=True)
    print(f"{len(paths)} files → {out} ({merged.count()} words)", file=sys.stderr)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glossaria")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("extract")
    one.add_argument("path")
    one.add_argument("-o", dest="out")
    many = commands.add_parser("merge")
    many.add_argument("paths", nargs="+")
    many.add_argument("-o", dest="out")
    got = parser.parse_args(args)
    spark = SparkSession.builder.appName("glossaria").getOrCreate()
    try:
        extract(spark, got.path, got.out) if got.command == "extract" else merge(spark, got.paths, got.out)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
