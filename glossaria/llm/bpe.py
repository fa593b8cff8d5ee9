"""Byte-level BPE through a table of distinct words.

Spark cuts texts at the tokenizer's special strings and then by its public word pattern.  A block of
documents keeps its words as numbers into its own list of distinct words; the list goes, dealt by
the words' hashes, to tasks that see each distinct word of the corpus in one place and encode it
once.  The ids come back to the block, where they join the words by position.  Decoding joins ids
to pieces through the tokenizer's own table, which the vocabulary bounds and each task holds.  What
moves is the lists of distinct words, never the texts or the numbered words, which stay in buckets by
block; a frequent word is one entry a block.  Lists follow the bytes of the texts, LIST_BYTES each.

The tokenizer file must be a byte-level BPE with the usual word pattern, no normalizer and only
plain special strings; others raise an error.  Its path is a parameter and must be there on every
machine.  Null and empty texts have no ids and decode to the empty text.  Rows that repeat stay.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glossaria.llm.common import Numbers, bucketed, n_buckets, power_of_two, runs, starts_of, text_bytes

#: What counts as white space, and the public word pattern of this kind of tokenizer.
BLANK = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
BLOCK_BYTES, LIST_BYTES = 22 << 20, 32 << 20


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """What is needed of a tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or not plain:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        to_byte = _byte_of_char()
        ids = spec["model"]["vocab"]
        pieces = [b""] * (1 + max([*ids.values(), *self.special.values()], default=0))
        for piece, i in ids.items():
            pieces[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
        for piece, i in self.special.items():
            pieces[i] = piece.encode()
        self.pieces = pa.array(pieces, pa.large_binary())
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts of runs of ids, which start and end at `ends`: ids joined to pieces, ill-formed UTF-8 replaced."""
        joined = self.pieces.take(pa.array(ids, pa.int64()))
        at = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1][ends] if len(ids) else np.zeros(len(ends), np.int64)
        data = joined.buffers()[2].to_pybytes() if len(ids) else b""
        texts = (data[s:e] for s, e in zip(at.tolist(), at[1:].tolist()))
        return [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in texts]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _pack(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def _pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, each of their four bytes in a plane of its own."""
    return _pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _pack_ranks(x: np.ndarray) -> bytes:
    """Numbers that are mostly small: a byte each, more for those from 192 on, the rest for the largest."""
    more = x[x >= 192] - 192
    rest = (more >> 8) - 63
    first = x.astype(np.uint8)
    first[x >= 192] = 192 + np.minimum(more >> 8, 63)
    return pickle.dumps((_pack(first.tobytes()), _pack((more & 255).astype(np.uint8).tobytes()), _pack_numbers(rest[rest >= 0])))


def _unpack_ranks(data: bytes) -> np.ndarray:
    first, low, rest = pickle.loads(data)
    x = np.frombuffer(zstandard.decompress(first), np.uint8).astype(np.int64)
    large = np.flatnonzero(x >= 192)
    high = x[large] - 192
    high[high == 63] += _unpack_numbers(rest)
    x[large] = 192 + (high << 8) + np.frombuffer(zstandard.decompress(low), np.uint8)
    return x


def _pack_words(words: list[str]) -> bytes:
    """A list of words as their lengths and bytes."""
    encoded = [w.encode("utf-8", "surrogatepass") for w in words]
    return _pack(np.array([len(encoded), *map(len, encoded)], "<u4").tobytes() + b"".join(encoded))


def _unpack_words(data: bytes) -> list[str]:
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:4], "little")
    sizes = np.frombuffer(data, "<u4", n, 4)
    at = (starts_of(sizes) + 4 * (n + 1)).tolist()
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at, at[1:])]


_PARTS = "block long, dealt int, words binary, numbers binary"


def _part(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "dealt", "words", "numbers"])


def _dealt(words: list[str], n: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % n for w in words), np.int64, len(words))


def words_of(text: Column, cut: str) -> Column:
    """The words of a text, in order; a special string, found by the pattern `cut`, is one word."""
    plain = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    if not cut:
        return plain(text)
    special = F.regexp_extract_all(text, F.lit(cut), F.lit(0))
    cut_up = F.flatten(F.transform(F.split(text, cut, -1), lambda t, k: F.when(k == 0, plain(t)).otherwise(F.concat(F.array(F.element_at(special, k)), plain(t)))))
    return F.when(text.rlike(cut), cut_up).otherwise(plain(text))


def _runs(batches, limit: int) -> Iterator[pa.Table]:
    """The rows of a partition in runs of texts of about limit bytes; a longer document is a run of its own."""
    held, size = [], 0
    for b in batches:
        at = 0
        for k, n in enumerate(b["size"].to_pylist()):
            if size and size + n > limit:
                held.append(b.slice(at, k - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, k
            size += n + 64
        held.append(b.slice(at))
    if size:
        yield pa.Table.from_batches(held)


def numbered(docs: DataFrame, path: str, n_dealt: int) -> DataFrame:
    """The blocks of docs(doc_id, words, size): one row with a block's documents as numbers of words, the others with its distinct words, dealt by hash."""

    def cut(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        for table in _runs(batches, BLOCK_BYTES):
            listed = table["words"].combine_chunks()
            lengths = np.diff(listed.offsets.to_numpy())
            coded = listed.flatten().dictionary_encode()
            flat, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            # a word's number modulo n_dealt says which list it goes to; within a list, frequent words come first
            at = _dealt(words, n_dealt)
            order = np.lexsort((-np.bincount(flat, minlength=len(words)), at))
            ends = starts_of(np.bincount(at, minlength=n_dealt))
            number = np.empty(len(words), np.int64)
            number[order] = (np.arange(len(words)) - ends[at[order]]) * n_dealt + at[order]
            yield _part([(block, -1, None, pickle.dumps((table["doc_id"].to_pylist(), lengths, _pack_ranks(number[flat]))))])
            rows = [(block, d, _pack_words([words[k] for k in order[ends[d] : ends[d + 1]]]), None) for d in range(n_dealt) if ends[d] < ends[d + 1]]
            if rows:
                yield _part(rows)
            block += 1

    return docs.mapInArrow(cut, _PARTS)


def encoded_words(parts: DataFrame, path: str) -> DataFrame:
    """(block, dealt, data): for each list of words the ids of its words, in order; each distinct word is encoded once."""

    def encode(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table, lists = vocabulary(path), Numbers(), []
        for b in batches:
            for block, data in zip(b["block"].to_pylist(), b["words"].to_pylist()):
                words = _unpack_words(data)
                lists.append((block, np.fromiter(map(table.__getitem__, words), np.int64, len(words))))
        ids = v.encode(list(table))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        at, flat = starts_of(sizes), np.fromiter((x for run in ids for x in run), np.int64, int(sizes.sum()))
        for block, words in lists:
            n = sizes[words]
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "dealt": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([pickle.dumps((_pack_numbers(n), _pack_numbers(flat[runs(at[words], n)])))], pa.binary())})

    return parts.where("dealt >= 0").select("block", "dealt", "words").groupBy("dealt").applyInArrow(encode, "block long, dealt int, data binary")


def encode(docs: DataFrame, path: str, consume=None, schema: str = "doc_id long, ids array<int>", with_text: bool = False) -> DataFrame:
    """(doc_id, ids) for every row of docs(doc_id, text).

    consume(vocabulary, doc_id, ids, decoded) may make another row of each document, of the given
    schema, so that long id lists needn't leave the task; decoded is their text, if asked for.
    """
    n_bytes = text_bytes(docs)
    n_dealt = power_of_two(max(n_bytes // LIST_BYTES, min(64, n_bytes // (4 << 20))), 16, 1 << 20)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(text, vocabulary(path).cut).alias("words"), F.octet_length(text).alias("size")), path, n_dealt)
    parts = bucketed(parts, "bpe_blocks", "block", n_buckets(docs.sparkSession, n_bytes))
    consume = consume or (lambda v, i, ids, text: (i, ids.tolist()))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def rejoin(left, right):
        v, rows = vocabulary(path), []
        for data in left["numbers"].to_pylist():
            doc_ids, lengths, flat = pickle.loads(data)
            flat = _unpack_ranks(flat)
            lists = {d: tuple(map(_unpack_numbers, pickle.loads(x))) for d, x in zip(right["dealt"].to_pylist(), right["data"].to_pylist())}
            sizes, first = (np.zeros(n_dealt * max((len(n) for n, _ in lists.values()), default=0), np.int64) for _ in range(2))
            at, found = 0, []
            for d, (n, ids) in sorted(lists.items()):
                sizes[d :: n_dealt][: len(n)] = n
                first[d :: n_dealt][: len(n)] = at + starts_of(n)[:-1]
                at += len(ids)
                found.append(ids)
            ids_of = np.concatenate(found) if found else np.empty(0, "<u4")
            ends = starts_of(lengths)
            for k in range(0, len(doc_ids), 256):  # a few documents at a time
                own = ends[k : k + 257]
                words = flat[own[0] : own[-1]]
                n = sizes[words]
                ids, at = ids_of[runs(first[words], n)], starts_of(n)[own - own[0]]
                texts = v.decoded(ids, at) if with_text else [None] * len(own)
                rows += [consume(v, i, ids[s:e], t) for i, s, e, t in zip(doc_ids[k : k + 256], at, at[1:], texts)]
        columns = list(zip(*rows)) or [()] * len(arrow)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    words = encoded_words(parts, path).groupBy("block")
    return parts.where("numbers IS NOT NULL").select("block", "numbers").groupBy("block").cogroup(words).applyInArrow(rejoin, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to the empty text."""

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            listed = b["ids"]
            ends = starts_of(np.nan_to_num(np.asarray(pc.list_value_length(listed).fill_null(0))))
            texts = v.decoded(listed.flatten().to_numpy(), ends)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids where they are."""

    def digest(v, i, ids, text):
        return i, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()

    return encode(docs, path, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", with_text=True)
