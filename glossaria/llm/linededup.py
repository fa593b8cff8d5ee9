"""Line dedup with two Bloom filters.

A line's key is the line without white space at its ends and with A-Z in lower case; keys shorter
than `least` code points never count.  Pass 1: 64-bit hashes of keys, once or twice a task, are dealt
to tasks, as many as the input needs, each with a Bloom filter of the hashes seen once; what it has
already is seen twice.  Pass 2: a second filter, of the hashes seen twice, lets only suspected keys
through, which are summed up exactly by a 128-bit digest (pre-aggregated in each task, so a line of a
third of all documents is a few rows).  Pass 3: keys of `copies` documents or more go from all documents
but the one with the largest id.  The first filter's size is fixed; if it is small for the input, more
keys reach the exact step and nothing else changes.  The second is broadcast when what it holds is
counted and few enough for 2^29 bits, and a join stands in for it otherwise; so for the digests to
drop, a table of at most `broadcast_keys`.

Each row is a document, also if ids repeat: rows that share the largest id all keep the line, and a
null id is smaller than any other.  Null or empty texts are one empty line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glossaria.llm.common import SPACES, Bloom, bloom_of, frozen, id_and_text, n_buckets, rows_of, text_bytes

BROADCAST_KEYS = 400_000
FILTER_BITS, FILTER_TEXT = 1 << 24, 64 << 20  # a filter's bits, and the bytes of text whose keys it is for: 16 bits for each key if they are 64 bytes apart
MOST_SUSPECTS = 1 << 25
_digest = xxhash.xxh3_128_digest


def key_of(line: bytes, least: int) -> bytes | None:
    key = line.strip(SPACES)
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return key.lower()


def _keys(text: bytes, least: int) -> set[bytes]:
    return {_digest(k) for line in text.split(b"\n") if len(line) >= least and (k := key_of(line, least)) is not None}


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8")[::2]


def suspected(docs: DataFrame, least: int, n: int, bits: int = FILTER_BITS) -> DataFrame:
    """(hash): hashes that may be of keys of two documents or more, by n filters of those seen once; those of keys of two or more are all there."""

    def mark(batches):
        held, size = [], 0

        def out():
            h, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times > 1)], ["hash", "twice"])

        for b in batches:
            for t in rows_of(b)[1]:
                if keys := _keys(t, least):
                    held.append(_hashes(list(keys)))
                    size += len(keys)
                    if size > 500_000:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    def sift(batches):
        once = Bloom(bits, 1)
        for b in batches:
            if not b.num_rows:
                continue
            h, times = np.unique(b["hash"].to_numpy().view(np.uint64), return_counts=True)
            more = np.zeros(len(h), bool)
            more[np.searchsorted(h, b["hash"].to_numpy().view(np.uint64)[b["twice"].to_numpy(zero_copy_only=False)])] = True
            again = h[once.has(h) | more | (times > 1)]
            once.add(h)
            yield pa.RecordBatch.from_arrays([pa.array(again.view(np.int64))], ["hash"])

    return docs.mapInArrow(mark, "hash long, twice boolean").repartition(n, "hash").mapInArrow(sift, "hash long").distinct()


def repeated_keys(docs: DataFrame, least: int, copies: int, n_filters: int, most_suspects: int = MOST_SUSPECTS) -> DataFrame:
    """(digest, last): the keys of `copies` documents or more and the largest id that holds each."""
    suspects = frozen(suspected(docs, least, n_filters), "suspected-lines")
    n = suspects.count()
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(suspects, n) if n <= most_suspects else None)

    def held(batches):
        filter_, found = shared.value, {}

        def out():
            digests = list(found)
            return pa.RecordBatch.from_pydict({"hash": pa.array(_hashes(digests).view(np.int64)), "digest": pa.array(digests, pa.binary()), "n": pa.array([x[0] for x in found.values()], pa.int64()), "last": pa.array([x[1] for x in found.values()], pa.int64())})

        for b in batches:
            for i, t in zip(*rows_of(b)):
                keys = list(_keys(t, least))
                if not keys:
                    continue
                for k in np.flatnonzero(filter_.has(_hashes(keys))) if filter_ else range(len(keys)):
                    many, last = found.get(keys[k], (0, None))
                    found[keys[k]] = (many + 1, i if last is None or i is not None and i > last else last)
            if len(found) > 200_000:
                yield out()
                found.clear()
        if found:
            yield out()

    sums = docs.mapInArrow(held, "hash long, digest binary, n long, last long")
    if n > most_suspects:
        sums = sums.join(suspects.distinct().withColumnRenamed("hash", "its_hash"), F.col("hash") == F.col("its_hash"), "left_semi")
    sums = sums.groupBy("digest").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return frozen(sums.where(F.col("n") >= copies).select("digest", "last"), "repeated-lines")


def drop_repeated(docs: DataFrame, least: int = 40, copies: int = 5, broadcast_keys: int = BROADCAST_KEYS, most_suspects: int = MOST_SUSPECTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_dropped) for every row of docs(doc_id, text); with columns to carry, they are in the struct `carried`."""
    spark, n_filters = docs.sparkSession, n_buckets(docs.sparkSession, text_bytes(docs), FILTER_TEXT)
    full, docs = id_and_text(docs, *carry), id_and_text(docs)
    keys = repeated_keys(docs, least, copies, n_filters, most_suspects)
    schema = StructType.fromDDL("doc_id long, kept_text string, n_lines long, n_dropped long")
    schema = schema.add("carried", full.schema["carried"].dataType) if carry else schema

    def kept(i, text, goes):
        lines = text.split(b"\n")
        stay = [x for x in lines if len(x) < least or (k := key_of(x, least)) is None or not goes(_digest(k), i)]
        return i, b"\n".join(stay).decode("utf-8", "replace"), len(lines), len(lines) - len(stay)

    def batch_of(rows, batch):
        i, t, n, d = zip(*rows)
        columns = {"doc_id": pa.array(i, pa.int64()), "kept_text": pa.array(t, pa.string()), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(d, pa.int64())}
        return pa.RecordBatch.from_pydict(columns | ({"carried": batch["carried"]} if carry else {}))

    if keys.count() <= broadcast_keys:
        shared = spark.sparkContext.broadcast({bytes(k): last for k, last in keys.collect()})

        def drop(batches):
            last = shared.value
            goes = lambda k, i: k in last and last[k] != i
            for b in batches:
                if b.num_rows:
                    yield batch_of([kept(i, t, goes) for i, t in zip(*rows_of(b))], b)

        return full.mapInArrow(drop, schema)

    def held(batches):
        for b in batches:
            pairs = [(i, k) for i, t in zip(*rows_of(b)) for k in _keys(t, least)]
            yield pa.RecordBatch.from_pydict({"holder": pa.array([p[0] for p in pairs], pa.int64()), "digest": pa.array([p[1] for p in pairs], pa.binary())})

    goes_from = docs.mapInArrow(held, "holder long, digest binary").join(keys, "digest").where(~F.col("last").eqNullSafe(F.col("holder")))
    per_doc = goes_from.groupBy("holder").agg(F.collect_set("digest").alias("gone"))

    def drop_listed(batches):
        for b in batches:
            if b.num_rows:
                yield batch_of([kept(i, t or b"", lambda k, _, g=frozenset(g or ()): k in g) for i, t, g in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["gone"].to_pylist())], b)

    return full.join(per_doc, F.col("doc_id").eqNullSafe(F.col("holder")), "left").drop("holder").mapInArrow(drop_listed, schema)


