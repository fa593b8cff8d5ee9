"""What the operators share: the shared folder, frozen tables, blocks of documents, Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.shared import bucketed, file_system, frozen, kept, n_buckets, new_path, removed, scratch, shared_dir  # noqa: F401  used beside these

#: The white space that separates words, as a character class and as the bytes to strip.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"


def id_and_text(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, text): text as UTF-8 bytes.  Other columns are left behind, so their names never clash; those to carry along are in one more, `carried`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *([F.struct(*(F.col(f"`{c.replace("`", "``")}`") for c in carry)).alias("carried")] if carry else []))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0


def numbered_rows(docs: DataFrame) -> DataFrame:
    """(its_row, doc): the rows of docs(text, ...) as structs with numbers of their own, written in buckets by number, so that what is found out of them can come back without moving them."""
    columns = F.struct(*(F.col(f"`{c.replace("`", "``")}`") for c in docs.columns)).alias("doc")
    return bucketed(docs.select(F.monotonically_increasing_id().alias("its_row"), columns), "numbered", "its_row", n_buckets(docs.sparkSession, text_bytes(docs)))


def rows_of(batch: pa.RecordBatch) -> tuple[list, list]:
    """The ids and texts (null: empty) of one Arrow batch of id_and_text."""
    return batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list]]:
    """The documents of a partition in runs of about limit bytes; a longer document is a block of its own."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(*rows_of(batch)):
            if ids and size + len(t) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t) + 64
    if ids:
        yield ids, texts


def starts_of(sizes) -> np.ndarray:
    """Offsets of consecutive runs, with the end as the last one."""
    return np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64)))).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of a well-known generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Numbers(dict):
    """Things numbered from 0 in the order they are first seen."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of one thing followed by another."""
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def hashes_at_length(h: np.ndarray, to: int) -> np.ndarray:
    """From hashes of words those of all runs of `to` words, doubling; the last step may overlap."""
    size = 1
    while size < to:
        step = min(2 * size, to)
        n = len(h) - (step - size)
        h, size = (joined(h[:n], h[step - size :][:n]) if n > 0 else h[:0]), step
    return h


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, first[1] .., and so on."""
    ends = starts_of(n)
    return np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)


def power_of_two(n: int, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, int(n) - 1).bit_length()))


class Bloom:
    """A Bloom filter of a fixed number of bits (a power of two) over 64-bit hashes, two bits a key.

    A key's two bits lie in the same of `slices` equal parts, chosen by the hash's lowest bits, so
    that parts can be built apart and put side by side.
    """

    def __init__(self, bits: int, slices: int, packed: np.ndarray | None = None):
        self.bits, self.slices = bits, slices
        self.packed = packed if packed is not None else np.zeros(bits // 8, np.uint8)

    @staticmethod
    def in_slice(h: np.ndarray, width: int, slices: int) -> np.ndarray:
        """The two bit positions of each key within its slice of `width` bits; shape (2, n)."""
        g = mixed(h // np.uint64(slices))
        return np.stack([g % np.uint64(width), (g >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(width)])

    def _at(self, h: np.ndarray) -> np.ndarray:
        width = self.bits // self.slices
        return Bloom.in_slice(h, width, self.slices) + (h % np.uint64(self.slices)) * np.uint64(width)

    def add(self, h: np.ndarray) -> None:
        at = self._at(h)
        np.bitwise_or.at(self.packed, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self._at(h)
        found = (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return (found[0] & found[1]).astype(bool)


def bits_of(positions: np.ndarray, width: int) -> np.ndarray:
    """Positions as a packed bit array, lowest bit first."""
    out = np.zeros(width, bool)
    out[positions] = True
    return np.packbits(out, bitorder="little")


def bloom_of(hashes: DataFrame, n: int, slices: int = 16) -> Bloom:
    """A filter of the n numbers in the single long column of hashes; it comes to the driver, of 2 ** 29 bits at most."""
    bits = power_of_two(16 * n, 1 << 16, 1 << 29)
    width = bits // slices

    def mark(batches):
        found = [np.empty(0, np.uint64)] + [b.column(0).to_numpy().view(np.uint64) for b in batches]
        h = np.unique(np.concatenate(found))
        part = h % np.uint64(slices)
        for s in range(slices if len(h) else 0):
            at = np.unique(Bloom.in_slice(h[part == s], width, slices)).astype("<u4")
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "at": pa.array([at.tobytes()], pa.binary())})

    def merge(table):
        found = np.concatenate([np.frombuffer(x, "<u4") for x in table["at"].to_pylist()])
        return pa.table({"slice": table["slice"][:1], "bits": pa.array([bits_of(found, width).tobytes()], pa.binary())})

    packed = np.zeros((slices, width // 8), np.uint8)
    for s, b in hashes.mapInArrow(mark, "slice int, at binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary").collect():
        packed[s] = np.frombuffer(b, np.uint8)
    return Bloom(bits, slices, packed.reshape(-1))
