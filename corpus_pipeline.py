"""A corpus for training: five stages over the documents, each an operator of glossaria.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's docs.  All but the last keep the columns of documents, and
any others of whatever name.  Each gives an empty table for one.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm import bpe, langid, linededup, mixing, neardup
from glossaria.llm.common import frozen, removed, scratch

ORACLE_SQL = None
TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, in which a language can be told; a null lang becomes the predicted one.

    Null and empty texts go.  If no row has a language and an id, nothing can be learned and all rows go.
    """
    return langid.recognized(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five of them or more hold, but for the last; n_chars is counted anew.

    A document that loses all its lines stays, with an empty text.  Rows that share the largest id all keep the line.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = linededup.drop_repeated(docs, carry=others)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(new.get(c, F.col("doc_id") if c == "doc_id" else F.col("carried").getField(c)).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; shingles of five words, similarity 0.8.

    A null id is larger than all, and of rows with one id the first stays.  Rows without words all stay.
    """
    return neardup.first_of_each(docs, size=5, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes its words: not at all, once, or up to four times.

    A source's words come within its longest document of what the mix takes.  Null sources are a source
    of their own; rows without words go; rows that repeat are drawn each by itself.
    """
    return mixing.resampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row of the mix; a null id stays null."""

    def row(v, i, ids, text):
        return i, len(ids), ids.astype("<i4"), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()

    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), row, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", with_text=True)


STAGES = [("language ID", language), ("line dedup", lines), ("near dedup", near_copies), ("mixing", mix), ("BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; of what they write on the way only the last stage's tables stay until the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as made:
            out = frozen(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.remove(out.frozen_at)
        if k:
            removed(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
