"""A stream's vocabulary as changes: a keyed state holds each lemma's flags, and only lemmas that are new or get a new flag come out.

What a task reads is merged, HELD lemmas or so at a time, before it is dealt by lemma, so a word that every document
has is a few rows.  State lives in RocksDB under the stream's checkpoint: a stream that starts again
goes on where it stopped, and words that come again change nothing and give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from glossaria.functions.lemma import lemma
from glossaria.functions.text import is_word, normalize, tokens

CHANGE = "lemma string, flags int, added int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def entries_of(docs: DataFrame, text: str = "text", flags: str | None = None) -> DataFrame:
    """(lemma, flags) of every accepted token of a stream (or a table); flags are those of a column, or none.  Names need a look at whole sentences of a corpus and stay in."""
    given = F.col(flags).cast("int") if flags else F.lit(0)
    found = docs.select(F.explode(F.array_distinct(tokens(normalize(F.col(text))))).alias("token"), given.alias("flags"))
    return found.where(is_word(F.col("token"))).select(lemma(F.col("token")).alias("lemma"), "flags")


#: Lemmas that a task holds before it passes them on.
HELD = 200_000


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int32())], ["lemma", "flags"])

    for b in batches:
        for word, flags in zip(b["lemma"].to_pylist(), b["flags"].to_pylist()):
            if word is not None:
                word = word.lower()
                held[word] = held.get(word, 0) | (flags or 0)
        if len(held) >= HELD:
            yield out()
            held.clear()
    if held:
        yield out()


class FlagMerge(StatefulProcessor):
    """The state of a lemma is its flags."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", "flags int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        new = 0
        for r in rows:
            new |= r["flags"]
        known = self.flags.get()
        old = known[0] if known else 0
        if not known or new | old != old:
            self.flags.update((new | old,))
            yield Row(lemma=key[0], flags=new | old, added=new & ~old)

    def close(self) -> None:
        pass


def changes(entries: DataFrame) -> DataFrame:
    """(lemma, flags, added) of a stream of entries(lemma, flags): a row whenever a lemma is new or gets flags that it hadn't, with all its flags and the new ones.  Null lemmas are left out."""
    combined = entries.select("lemma", F.col("flags").cast("int").alias("flags")).mapInArrow(_combined, "lemma string, flags int")
    return combined.groupBy("lemma").transformWithState(FlagMerge(), CHANGE, "Update", "None")


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def record(entries: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts writing a stream's changes as a table at path, one folder `batch=<n>` a batch, which a batch that runs again replaces."""
    spark = entries.sparkSession
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
    with _rocks(spark):
        return changes(entries).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
