"""Rows of conversations in order, without ever putting a whole conversation into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from glossaria.llm.common import frozen, n_buckets, text_bytes


def in_order(rows: DataFrame, key: str, order: tuple[str, ...], sums: dict[str, str], name: str) -> DataFrame:
    """rows with `position`, from 0 within each key, and for each of sums (name: long column) what the rows of the key before it add up to; a written table.

    Ranges of (key, order, the row's own number) are dealt out, so a key with many rows, even all
    alike, is parted over as many tasks as its bytes need.  Each task counts from its own beginning; what
    a key has in the ranges before is added afterwards.  Only the first key of a range has any, so that
    table has a row for each range at most and is broadcast.  Nulls in key or order come first.
    """
    n = n_buckets(rows.sparkSession, text_bytes(rows))
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(n, key, *order, "tie").sortWithinPartitions(key, *order, "tie").drop("tie")
    added = ["part", "position", *sums]
    schema = StructType(list(dealt.schema.fields))
    for c in added:
        schema = schema.add(c, LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), (0, None), np.zeros(1 + len(sums), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            own = b.schema.get_field_index(key)
            null = pc.is_null(b.column(own)).to_numpy(zero_copy_only=False)
            keys = pc.fill_null(b.column(own), 0).to_numpy(zero_copy_only=False)
            new = np.concatenate(([last != (keys[0], null[0])], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])))
            group, out = np.cumsum(new), []
            for k, c in enumerate([np.ones(len(keys), np.int64), *(b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in sums.values())]):
                through = np.cumsum(c)
                before = through - c
                found = before - np.concatenate(([0], before[new]))[group]
                found[group == 0] += carried[k]
                carried[k] = found[-1] + c[-1]
                out.append(pa.array(found, pa.int64()))
            last = keys[-1], null[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(keys), part), pa.int64()), *out], schema.names)

    table = frozen(dealt.mapInArrow(count, schema), name)
    ends = table.groupBy(key, "part").agg(F.count("*").alias("position"), *(F.sum(c).alias(x) for x, c in sums.items()))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    names = ["position", *sums]
    more = ends.select(F.col(key).alias("its_key"), F.col("part").alias("its_part"), *(F.sum(x).over(earlier).alias(f"{x}_more") for x in names)).where("position_more IS NOT NULL")
    more = frozen(more, f"{name}-before")
    both = table.join(F.broadcast(more), F.col(key).eqNullSafe(F.col("its_key")) & (F.col("part") == F.col("its_part")), "left")
    return both.select(*rows.columns, *((F.col(x) + F.coalesce(f"{x}_more", F.lit(0))).alias(x) for x in names))


def by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with those of a key next to each other and in order, for a reader that holds one row at a time."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of by_key, as tuples, a batch's columns at a time."""
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))
