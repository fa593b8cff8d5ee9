"""A vocabulary as a log of changes: writers only append, readers merge.

A change is written as a table of its own (a delta: lemma and the flags to set) and then gets the next
number in the log, a small file that is put in place only if no other writer has taken that number.
Merging is a bitwise OR, so deltas may be applied in any order and a writer that comes too late just
takes the next number: nobody's words are lost and nothing is computed anew.  A merge writes about as
much as it brings, whatever the store's size.

Now and then (`compact`) all deltas are merged into a base, bucketed by lemma, so that reading moves the
deltas to the base and not the base.  A base says up to which number it holds everything, so deltas that
come while it is made are simply read beside it.  Clearing puts a mark in the log: nothing before it
counts, neither do bases made of what was before.  Files that no reader of the last two bases needs are
deleted by `vacuum`.

The log's files are put in place by a link (local paths) or by a rename that doesn't overwrite, which is
atomic on HDFS; a store without either needs one writer at a time.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.operators import words
from glossaria.shared import file_system
from glossaria.sources import list_files, list_sink, wordlist_csv

#: A base is made when so many deltas have gathered, or deltas of so large a part of the base's rows.
MOST_DELTAS, DELTA_SHARE = 16, 0.5


class VocabularyStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, most_deltas: int = MOST_DELTAS):
        self.spark, self.path, self.most_deltas = spark, path.rstrip("/"), most_deltas
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # --- the log ---

    def _entries(self) -> list[dict]:
        """The log, in order: dicts of version, kind (delta, base or clear), data, rows, upto and buckets."""
        fs, top = file_system(self.spark, f"{self.path}/log")
        if not fs.exists(top):
            return []
        names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(top)) if n.endswith(".json") and not n.startswith("."))
        return [json.loads(self._read(f"{self.path}/log/{n}")) | {"version": int(n[:-5])} for n in names]

    def _read(self, at: str) -> str:
        fs, path = file_system(self.spark, at)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, entry: dict, known: list[dict]) -> dict:
        """Gives the entry the next free number."""
        n = known[-1]["version"] + 1 if known else 1
        while not self._put(f"{self.path}/log/{n:09d}.json", json.dumps(entry)):
            n += 1
        return entry | {"version": n}

    def _put(self, at: str, content: str) -> bool:
        """Makes a file with its whole content, or does nothing and says False if there is one."""
        fs, path = file_system(self.spark, at)
        hidden = path.getParent().suffix(f"/.{uuid.uuid4().hex}")
        out = fs.create(hidden)
        out.write(content.encode())
        out.close()
        try:
            if fs.getScheme() == "file":
                os.link(hidden.toUri().getPath(), path.toUri().getPath())
                return True
            return not fs.exists(path) and fs.rename(hidden, path)
        except FileExistsError:
            return False
        finally:
            fs.delete(hidden, False)

    @staticmethod
    def _state(entries: list[dict]) -> tuple[dict | None, list[dict]]:
        """The base to read and the deltas beside it; marks that were set on what a clear has taken away don't count."""
        cleared = max((e["version"] for e in entries if e["kind"] == "clear"), default=0)
        base = max((e for e in entries if e["kind"] == "base" and e["upto"] >= cleared), key=lambda e: e["upto"], default=None)
        since = max(cleared, base["upto"] if base else 0)
        return base, [e for e in entries if e["kind"] == "delta" and e["version"] > since and e.get("of", cleared) >= cleared]

    # --- reading ---

    def _base(self, base: dict) -> DataFrame:
        """The base's table with its buckets; its name is only needed until it is read."""
        name = f"store_{uuid.uuid4().hex}"
        at = base["data"].replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({words.ENTRY}) USING parquet CLUSTERED BY (lemma) INTO {base['buckets']} BUCKETS LOCATION '{at}'")
        found = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return found

    def _table(self, entries: list[dict]) -> DataFrame:
        base, deltas = self._state(entries)
        if not base and not deltas:
            return self.spark.createDataFrame([], words.ENTRY)
        if not deltas:
            return self._base(base)
        more = words.merge_entries(self.spark.read.schema(words.ENTRY).parquet(*(d["data"] for d in deltas)))
        if not base:
            return more
        more = more.select(F.col("lemma").alias("its_lemma"), F.col("flags").alias("its_flags")).repartition(base["buckets"], "its_lemma")  # to the base's buckets
        both = self._base(base).join(more, F.col("lemma") == F.col("its_lemma"), "full")
        zero = F.lit(0)
        return both.select(F.coalesce("lemma", "its_lemma").alias("lemma"), F.coalesce("flags", zero).bitwiseOR(F.coalesce("its_flags", zero)).alias("flags"))

    def get_all(self) -> DataFrame:
        return self._table(self._entries())

    def list_pending(self) -> DataFrame:
        return words.pending(self.get_all())

    def counts(self) -> DataFrame:
        return words.counts(self.get_all())

    # --- writing ---

    def _new_data(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def _delta(self, entries: DataFrame) -> dict | None:
        """entries written as a delta that isn't in the log yet; None, and nothing is left, if there are none."""
        at = self._new_data()
        entries.select("lemma", "flags").write.option("compression", "zstd").parquet(at)
        rows = self.spark.read.schema(words.ENTRY).parquet(at).count()
        if not rows:
            self._remove(at)
            return None
        return {"kind": "delta", "data": at, "rows": rows}

    def _remove(self, at: str) -> None:
        fs, path = file_system(self.spark, at)
        fs.delete(path, True)

    def _compact_if_due(self) -> None:
        base, deltas = self._state(self._entries())
        brought = sum(d["rows"] for d in deltas)
        if len(deltas) >= self.most_deltas or base and len(deltas) > 1 and brought > DELTA_SHARE * base["rows"]:
            self.compact()

    def merge_collected(self, entries: DataFrame) -> None:
        delta = self._delta(words.merge_entries(entries.where("lemma IS NOT NULL")))
        if delta:
            self._commit(delta, self._entries())
            self._compact_if_due()

    def mark_pushed(self, lemmas: DataFrame) -> bool:
        """False, and nothing written, if no flag changes."""
        hits = lemmas.select(F.lower("lemma").alias("hit")).distinct()
        known = self._entries()
        fresh = self._table(known).where(F.col("flags").bitwiseAND(F.lit(words.PUSHED_FLAG)) == 0).join(hits, F.col("lemma") == F.col("hit"), "left_semi")
        delta = self._delta(fresh.select("lemma", F.lit(words.PUSHED_FLAG).alias("flags")))
        if not delta:
            return False
        done = self._commit(delta | {"of": known[-1]["version"]}, known)
        if any(e["kind"] == "clear" and done["of"] < e["version"] < done["version"] for e in self._entries()):
            return False  # what was marked was cleared meanwhile
        self._compact_if_due()
        return True

    def clear(self) -> None:
        self._commit({"kind": "clear"}, self._entries())

    def compact(self) -> None:
        """Merges all that is there now into a new base."""
        known = self._entries()
        if not known:
            return
        at, name = self._new_data(), f"store_{uuid.uuid4().hex}"
        table = self._table(known).repartition(self.buckets, "lemma")
        table.write.bucketBy(self.buckets, "lemma").sortBy("lemma").option("path", at).option("compression", "zstd").saveAsTable(name)
        rows = self.spark.table(name).count()
        self.spark.sql(f"DROP TABLE {name}")
        self._commit({"kind": "base", "data": at, "rows": rows, "upto": known[-1]["version"], "buckets": self.buckets}, known)

    def vacuum(self) -> int:
        """Deletes what was replaced before the last base but one; how many tables those were."""
        known = self._entries()
        bases = sorted((e for e in known if e["kind"] == "base"), key=lambda e: e["upto"])
        if len(bases) < 2:
            return 0
        old = [e for e in known if e["version"] <= bases[-2]["upto"] and e["kind"] != "clear"]
        for e in old:
            self._remove(e["data"])
            self._remove(f"{self.path}/log/{e['version']:09d}.json")
        return len(old)

    # --- lists ---

    def import_csv(self, files: DataFrame) -> None:
        """Merges files(file, content), or raises and writes nothing if a row of any is bad."""
        self.merge_collected(wordlist_csv.checked(wordlist_csv.read_lists(files)))

    def import_files(self, paths: DataFrame) -> None:
        """The same for files(file) of any size, each read by many tasks."""
        self.merge_collected(wordlist_csv.checked(list_files.read(paths)))

    def export_csv(self) -> str:
        """The whole list as one text, for a message."""
        return wordlist_csv.to_csv(self.get_all())

    def export_file(self, path: str) -> None:
        """The whole list as one file, written by the executors."""
        list_sink.write_list(self.get_all(), path, single=True)
