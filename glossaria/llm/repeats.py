"""Finding what repeats across blocks of documents by exchanges, at each of which a block sends packed
keys and gets back what it needs.

`framed` freezes the documents as blocks, a compressed row each, in the form that `prepare` gives them,
bucketed by block, so that blocks never move again; only keys, candidates and answers do.
At each level a block sends 64-bit keys of what may still repeat; tasks that each see all blocks' keys of
one range tell every block which of its keys occur twice or more anywhere, and which `crowd` times or
more.  The next level looks at what lies over those keys alone.  When no key is left, nothing repeats;
after the last level `emit` sends packed candidates, dealt by range, `resolve` compares all blocks'
candidates of a range and answers blocks by number, and `finish` makes the rows.  If any key was
crowded, `recheck` and `confirm` are one exchange more, of what the answers only suspect.

A key as frequent as one document in three is one entry a block.  Ranges follow the bytes of the texts,
RANGE_BYTES each once there are more than FEW of them.  A row goes from a block to a range only if it
has a key there, so rows never outnumber keys; nothing but counts goes to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import blocks, bucketed, frozen, id_and_text, n_buckets, power_of_two, text_bytes

BLOCK_BYTES = 12 << 20
RANGE_BYTES = 128 << 20
FEW, FEW_BYTES = 256, 8 << 20  # up to so many ranges may be smaller, for the sake of idle cores
MOST = (1 << 16) - 1


def packed(data: bytes, level: int = 1) -> bytes:
    return zstandard.compress(data, level)


def unpacked(data: bytes) -> bytes:
    return zstandard.decompress(data)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers: differences, byte by byte."""
    d = np.diff(x.astype("<u8"), prepend=np.uint64(0)).astype("<u8")
    return packed(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
    return np.cumsum(d, dtype=np.uint64)


def in_ranges(x: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges (a power of two) of the 64-bit numbers starts in ascending x, and the end."""
    inner = np.arange(1, n, dtype=np.uint64) << np.uint64(65 - n.bit_length())
    return np.concatenate(([0], np.searchsorted(x, inner), [len(x)])).astype(np.int64)


def range_of(key: int, n: int) -> int:
    return key >> (65 - n.bit_length())


def framed(docs: DataFrame, prepare: Callable, n: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, data): the frozen blocks of docs(doc_id, text) in n buckets; data holds what prepare(ids, texts) made of a block."""

    def frame(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for ids, texts in blocks(batches, block_bytes):
            data = packed(pickle.dumps(prepare(ids, texts)), 3)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])
            number += 1

    return bucketed(id_and_text(docs).mapInArrow(frame, "block long, data binary"), "blocks", "block", n)


def n_ranges(n_bytes: int) -> int:
    return power_of_two(max(n_bytes // RANGE_BYTES, min(FEW, n_bytes // FEW_BYTES)), 16, 1 << 24)


_SENT = "block long, part int, data binary"
_KNOWN = "block long, part int, found long, crowded long, data binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    block, part, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["block", "part", "data"])


def exchanged(docs: DataFrame, prepare: Callable, levels: list[Callable], emit: Callable, resolve: Callable, finish: Callable, arrow: pa.Schema, schema: str, crowd: int = MOST, recheck: Callable | None = None, confirm: Callable | None = None) -> DataFrame:
    """Runs the exchanges over docs(doc_id, text); see the module.

    levels[n](state, known) gives a block's keys, known being those of the level before that repeat;
    emit(state, known, crowded, n_parts) and recheck(state, known, crowded, answers, n_parts) give (part, data),
    resolve(sent) and confirm(sent) give (block, answer) for sent [(block, data)], finish(state, answers) rows.
    """
    if crowd > MOST:
        raise ValueError(f"a block counts a key {MOST} times at most")
    n_bytes = text_bytes(docs)
    framed_docs, n_parts = framed(docs, prepare, n_buckets(docs.sparkSession, n_bytes)), n_ranges(n_bytes)
    by_block = framed_docs.groupBy("block")

    def keys_rows(block: int, found: np.ndarray) -> pa.RecordBatch:
        keys, n = np.unique(found, return_counts=True)
        ends, n = in_ranges(keys, n_parts), np.minimum(n, MOST).astype("<u2")
        return _sent([(block, p, pickle.dumps((pack_sorted(keys[s:e]), packed(n[s:e].tobytes())))) for p, (s, e) in enumerate(zip(ends, ends[1:])) if s < e])

    def compare_keys(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, keys, many = [], [], []
        for b in batches:
            for block, data in zip(b["block"].to_pylist(), b["data"].to_pylist()):
                k, n = pickle.loads(data)
                of.append(block)
                keys.append(unpack_sorted(k))
                many.append(np.frombuffer(unpacked(n), "<u2").astype(np.int64))
        merged = np.sort(np.concatenate(keys))
        shared = merged[1:][merged[1:] == merged[:-1]]
        shared = shared[np.concatenate(([True], shared[1:] != shared[:-1]))] if len(shared) else shared
        total, places = np.zeros(len(shared) + 1, np.int64), []  # the last for keys of one block
        for k, m in zip(keys, many):
            at = np.searchsorted(shared, k)
            at[np.append(shared, np.uint64(0))[at] != k] = len(shared)
            total[at] += m  # a block has a key once
            places.append(at)
        rows = []
        for block, m, at in zip(of, many, places):
            n = np.where(at < len(shared), total[at], m)
            rows.append((block, key[0].as_py(), int((n > 1).sum()), int((n >= crowd).sum()), packed(np.packbits(np.stack([n > 1, n >= crowd])).tobytes())))
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["block", "part", "found", "crowded", "data"])

    def told(level: int, state, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a block at a level that repeat anywhere, and which of them are crowded, from the answers of the levels up to it."""
        keys = np.unique(levels[level](state, told(level - 1, state, answers)[0] if level else None))
        ends, bits = in_ranges(keys, n_parts), np.zeros((2, len(keys)), bool)
        for p in answers[level]:
            s, e = ends[p], ends[p + 1]
            bits[:, s:e] = np.unpackbits(np.frombuffer(unpacked(answers[level][p]), np.uint8), count=2 * (e - s)).reshape(2, -1)
        return keys[bits[0]], bits[1][bits[0]]

    def answers_of(right: pa.Table) -> list[dict]:
        found: list[dict] = [{} for _ in levels]
        for level, part, data in zip(right["level"].to_pylist(), right["part"].to_pylist(), right["data"].to_pylist()):
            if level >= 0:
                found[level][part] = data
        return found

    def states(left):
        for block, data in zip(left["block"].to_pylist(), left["data"].to_pylist()):
            yield block, pickle.loads(unpacked(data))

    def conclude(left, right):
        rows = []
        for _, state in states(left):
            rows += finish(state, right["data"].to_pylist())
        columns = list(zip(*rows)) or [()] * len(arrow)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def settled_by(answer: Callable):
        def settle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = [(block, data) for b in batches for block, data in zip(b["block"].to_pylist(), b["data"].to_pylist())]
            rows = [(block, key[0].as_py(), data) for block, data in answer(sent)]
            if rows:
                yield _sent(rows)

        return settle

    def first(batches):
        for b in batches:
            for block, data in zip(b["block"].to_pylist(), b["data"].to_pylist()):
                yield keys_rows(block, levels[0](pickle.loads(unpacked(data)), None))

    def next_at(level: int):
        def next_(left, right):
            found = answers_of(right)
            return pa.Table.from_batches([keys_rows(block, levels[level](state, told(level - 1, state, found)[0])) for block, state in states(left)] or [_sent([])])

        return next_

    known, crowded = None, 0
    for level in range(len(levels)):
        sent = by_block.cogroup(known.groupBy("block")).applyInArrow(next_at(level), _SENT) if level else framed_docs.mapInArrow(first, _SENT)
        here = frozen(sent.groupBy("part").applyInArrow(compare_keys, _KNOWN).withColumn("level", F.lit(level)), "known")
        found, crowded = here.agg(F.sum("found"), F.sum("crowded")).first()
        if not found:  # no candidate survives
            none = framed_docs.sparkSession.createDataFrame([], _SENT)
            return by_block.cogroup(none.groupBy("block")).applyInArrow(conclude, schema)
        known = known.unionByName(here) if level else here

    def send_candidates(left, right):
        found, rows = answers_of(right), []
        for block, state in states(left):
            keys, many = told(len(levels) - 1, state, found)
            if len(keys):
                rows += [(block, p, sent) for p, sent in emit(state, keys, many, n_parts)]
        return pa.Table.from_batches([_sent(rows)])

    def send_suspects(left, right):
        found, rows = answers_of(right), []
        said = [data for level, data in zip(right["level"].to_pylist(), right["data"].to_pylist()) if level < 0]
        for block, state in states(left):
            if said:
                keys, many = told(len(levels) - 1, state, found)
                rows += [(block, p, sent) for p, sent in recheck(state, keys, many, said, n_parts)]
        return pa.Table.from_batches([_sent(rows)])

    candidates = by_block.cogroup(known.groupBy("block")).applyInArrow(send_candidates, _SENT)
    answers = candidates.groupBy("part").applyInArrow(settled_by(resolve), _SENT)
    if crowded and recheck:
        answers = frozen(answers, "answers")
        both = known.select(*answers.columns, "level").unionByName(answers.withColumn("level", F.lit(-1)))
        suspects = by_block.cogroup(both.groupBy("block")).applyInArrow(send_suspects, _SENT)
        answers = answers.unionByName(suspects.groupBy("part").applyInArrow(settled_by(confirm), _SENT))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(conclude, schema)
