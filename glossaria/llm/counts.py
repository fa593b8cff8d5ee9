"""Token counts as delta-maintained rollups.

A batch is a table of signed rows: +1 adds a document with its count, -1 takes one away, and a
revised count is a -1 row with the old count beside a +1 row with the new one.  Totals are sums, so
batches may come in any order.  Each batch is summed per key and written to a folder of its own; it
counts once Spark's success marker is there, and a batch whose id is committed already is left
alone, so a retried or repeated commit changes nothing.  `compact` folds the committed batches
into a snapshot that lists them.  One writer at a time.

`counted` counts the tokens of texts by any of three tokenizers.  `Counted` keeps the documents' own
counts beside the totals, so that who deletes or revises a document needn't know its old count.

Null keys are keys; null signs or counts are 0; an empty batch commits nothing but its id; rows
that repeat count as often as they are there; other columns are ignored.  Null texts have no tokens.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import WORD_PATTERN, new_path

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "rollup")

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _complete(self, kind: str) -> list[str]:
        """The names of the folders of a kind that hold a finished write."""
        fs, top = self._fs(f"{self.path}/{kind}")
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(n for n in names if fs.exists(self._fs(f"{self.path}/{kind}/{n}/_SUCCESS")[1]))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds deltas(source, lang, tokenizer, sign, n_tokens); False if the batch is there already."""
        if not re.fullmatch(r"[A-Za-z0-9.-]+", batch):
            raise ValueError(f"a batch id has letters, digits, dots and dashes: {batch!r}")
        if batch in self.committed():
            return False
        sign = F.coalesce(F.col("sign").cast("long"), F.lit(0))
        sums = deltas.groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))).alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch/{batch}")
        return True

    def committed(self) -> set[str]:
        return {*self._complete("batch"), *self._folded()}

    def _snapshot(self) -> str | None:
        return max((n for n in self._complete("folded")), default=None)

    def _folded(self) -> set[str]:
        last = self._snapshot()
        return {r[0] for r in self.spark.read.text(f"{self.path}/folded/{last}").collect()} if last else set()  # batch ids

    def compact(self) -> None:
        """A new snapshot; its list of batches is written last and makes it valid."""
        last, done = self._snapshot(), self._folded()
        new = [b for b in self._complete("batch") if b not in done]
        if new:
            name = f"{int(last or 0) + 1:09d}"
            self.totals().write.mode("overwrite").parquet(f"{self.path}/snapshot/{name}")
            self.spark.createDataFrame([(b,) for b in sorted(done | set(new))], "batch string").coalesce(1).write.mode("overwrite").text(f"{self.path}/folded/{name}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens): keys whose sums are both 0 are gone."""
        last, done = self._snapshot(), self._folded()
        paths = [f"{self.path}/batch/{b}" for b in self._complete("batch") if b not in done]
        paths += [f"{self.path}/snapshot/{last}"] if last else []
        parts = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        sums = parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


WORDS = "words-1"


@lru_cache(2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) for docs(doc_id, source, lang, text).

    Without a path a token is a word; with one, the file's byte-level BPE of the usual word pattern
    encodes every whole text, special strings as ordinary text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")]
    if path is None:
        return docs.select(*keys, F.lit(tokenizer).alias("tokenizer"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("n_tokens"))

    def run(batches):
        encoding = _encoding(path)
        for b in batches:
            n = [len(encoding.encode_ordinary(t.as_py())) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], b["lang"], pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    return docs.select(*keys, text.alias("text")).mapInArrow(run, _COUNTED)


_COUNTED = "doc_id long, source string, lang string, tokenizer string, n_tokens long"


class Counted:
    """A rollup with the counts of each document and tokenizer, as tables of signed rows that are written before the totals change.

    Rows that repeat count as often as they are there: removing a document takes away all its rows.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.rollup = Rollup(spark, path)
        self.spark, self.path = spark, self.rollup.path

    def documents(self) -> DataFrame:
        """(doc_id, source, lang, tokenizer, n_tokens, n): what counts now, with how many rows of it there are."""
        batches = self.rollup.committed()
        paths = [f"{self.path}/rows/{b}" for b in self.rollup._complete("rows") if b in batches]
        rows = self.spark.read.schema(_COUNTED + ", sign long").parquet(*paths) if paths else self.spark.createDataFrame([], _COUNTED + ", sign long")
        return rows.groupBy("doc_id", "source", "lang", "tokenizer", "n_tokens").agg(F.sum("sign").alias("n")).where("n <> 0")

    def _commit(self, batch: str, signed: DataFrame) -> bool:
        if batch in self.rollup.committed():
            return False
        signed.select("doc_id", "source", "lang", "tokenizer", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("sign").cast("long").alias("sign")).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/rows/{batch}")
        return self.rollup.commit(batch, self.spark.read.schema(_COUNTED + ", sign long").parquet(f"{self.path}/rows/{batch}"))

    def add(self, batch: str, counts: DataFrame) -> bool:
        """Adds documents with their counts."""
        return self._commit(batch, counts.withColumn("sign", F.lit(1)))

    def remove(self, batch: str, ids: DataFrame) -> bool:
        """Takes away the documents of ids(doc_id), whatever they counted."""
        gone = ids.select(F.col("doc_id").alias("its_id")).distinct()
        return self._commit(batch, self.documents().join(gone, F.col("doc_id") == F.col("its_id"), "left_semi").withColumn("sign", -F.col("n")))

    def revise(self, batch: str, counts: DataFrame) -> bool:
        """New counts in place of the old ones of the same documents and tokenizers; documents that aren't there are added."""
        new = counts.select("doc_id", "source", "lang", "tokenizer", "n_tokens")
        told = new.select(F.col("doc_id").alias("its_id"), F.col("tokenizer").alias("its_tokenizer")).distinct()
        old = self.documents().join(told, (F.col("doc_id") == F.col("its_id")) & F.col("tokenizer").eqNullSafe(F.col("its_tokenizer")), "left_semi")
        return self._commit(batch, old.withColumn("sign", -F.col("n")).drop("n").unionByName(new.withColumn("sign", F.lit(1).cast("long"))))

    def totals(self) -> DataFrame:
        return self.rollup.totals()
