"""Media columns: content-addressed payloads in tar shards.

`store` turns each text into a grey-scale PNG (its UTF-8 bytes, padded, are the 8-bit samples) and
appends it to a tar shard in the shared folder, once per distinct content and task.  A row carries
digest, shard, offset and length.  A shard is named by its own digest and written in one piece, so
a task that runs twice leaves the same files or unused ones, never a wrong offset.  Then addresses
become global: of the copies of one content that several tasks stored, the first by shard and offset
is everyone's; the others are never read, and `unused` lists them.  Only addresses move for that, no
payloads.  `headers` fills metadata columns by reading only the first 33 bytes of each payload,
`read_back` reads the stored bytes, checks them against the digest and computes features.

Shards are read and written by Arrow's file systems; s3a and s3n folders are taken as s3.

Null and empty texts are one block of padding.  Equal texts give equal values.  Rows of the input
that repeat give rows that repeat.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import frozen, id_and_text, n_buckets, new_path, rows_of

UNIT = 576
SHARD_BYTES = 16 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def padded(data: bytes, unit: int = UNIT, fill: int = 255) -> bytes:
    return data + bytes([fill]) * (max(1, -(-len(data) // unit)) * unit - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, width: int = UNIT) -> bytes:
    """An 8-bit grey-scale picture whose samples are the payload, a multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)  # each line starts with filter type 0
    raw[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG payload")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a picture written by to_png."""
    width, height, _ = png_header(data)
    at, body = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("unexpected filter type")
    return raw[:, 1:].tobytes()


def features(payload: bytes, width: int, height: int) -> str:
    """Size, mean, extremes and an eight-bin histogram of the samples, all whole numbers."""
    x = np.frombuffer(payload, np.uint8)
    return f"{width}x{height} mean={int(x.sum(dtype=np.int64)) // len(x)} min={x.min()} max={x.max()} hist={'/'.join(map(str, np.bincount(x >> 5, minlength=8)))}"


def _member(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def arrow_name(at: str) -> str:
    """A path as Arrow's file systems know it."""
    scheme, mark, rest = at.partition("://")
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest


def file_system(at: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(arrow_name(at))


def store(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length), written: the shards are complete when this returns, and each content has one address."""
    folder = folder or new_path(docs.sparkSession, "media")
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]

    def write(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        where: dict[bytes, tuple] = {}  # text digest -> where a closed shard holds it
        shard, fresh, waiting = bytearray(), {}, []

        def flush():
            body = bytes(shard) + bytes(1024)  # two empty blocks end a tar
            name = f"{hashlib.sha256(body).hexdigest()}.tar"
            if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                import uuid

                with fs.open_output_stream(part := f"{root}/.{uuid.uuid4().hex}") as out:
                    out.write(body)
                fs.move(part, f"{root}/{name}")
            where.update({k: (d, f"{folder}/{name}", o, n) for k, (d, o, n) in fresh.items()})
            rows = [(i, n, *where[k]) for i, n, k in waiting]
            shard.clear(), fresh.clear(), waiting.clear()
            return _table(schema, rows)

        for batch in batches:
            for i, text in zip(*rows_of(batch)):
                key = hashlib.sha256(text).digest()
                if key not in where and key not in fresh:
                    data = to_png(padded(text))
                    digest = hashlib.sha256(data).hexdigest()
                    shard += _member(f"{digest}.png", len(data))
                    fresh[key] = (digest, len(shard), len(data))
                    shard += data + bytes(-len(data) % 512)
                waiting.append((i, len(text), key))
                if len(shard) >= shard_bytes or len(waiting) >= 20_000:
                    yield flush()
        if waiting:
            yield flush()

    rows = frozen(id_and_text(docs).mapInArrow(write, _STORED), "stored-by-task")
    n = n_buckets(docs.sparkSession, rows.agg(F.sum("length")).first()[0] or 0)
    settled = rows.join(moved(rows).drop("length"), (F.col("digest") == F.col("its_digest")) & (F.col("shard") == F.col("its_shard")), "left").select(
        "doc_id", "n_bytes", "digest", F.coalesce("to.shard", "shard").alias("shard"), F.coalesce("to.offset", "offset").alias("offset"), "length"
    )
    # by place, so that a task reads few shards, each in order; rows of one content may be many
    return frozen(settled.repartitionByRange(n, F.xxhash64("shard"), "offset", "doc_id").sortWithinPartitions("shard", "offset"), "media-rows")


def moved(rows: DataFrame) -> DataFrame:
    """(its_digest, its_shard, its_offset, length, to): copies of contents that have their address elsewhere, from what tasks stored."""
    copies = rows.groupBy("digest", "shard").agg(F.min("offset").alias("offset"), F.first("length").alias("length"))
    first = copies.groupBy("digest").agg(F.min(F.struct("shard", "offset")).alias("to"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of_digest"), "to")
    found = copies.join(first, F.col("digest") == F.col("of_digest")).where(F.col("shard") != F.col("to.shard"))
    return found.select(F.col("digest").alias("its_digest"), F.col("shard").alias("its_shard"), F.col("offset").alias("its_offset"), "length", "to")


def unused(rows: DataFrame) -> DataFrame:
    """(shard, offset, length): payloads that nothing refers to, of the rows as tasks stored them."""
    return moved(rows).select(F.col("its_shard").alias("shard"), F.col("its_offset").alias("offset"), "length")


class _Shards:
    """Range reads, with the last shard kept open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            fs, path = file_system(shard)
            self.name, self.file = shard, fs.open_input_file(path)
        return self.file.read_at(length, offset)


def headers(stored: DataFrame) -> DataFrame:
    """Adds width, height and bits, read from the payloads' headers alone."""

    def read(batches):
        shards = _Shards()
        for b in batches:
            found = [png_header(shards.read(s, o, min(33, n))) for s, o, n in zip(b["shard"].to_pylist(), b["offset"].to_pylist(), b["length"].to_pylist())]
            for k, name in enumerate(("width", "height", "bits")):
                b = b.append_column(name, pa.array([x[k] for x in found], pa.int64()))
            yield b

    return stored.select("doc_id", "n_bytes", "digest", "shard", "offset", "length").mapInArrow(read, _STORED + ", width long, height long, bits long")


def read_back(described: DataFrame) -> DataFrame:
    """Reads every payload from its shard, fails if the bytes don't match the digest, and describes what it holds."""
    out = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def read(batches):
        shards, last = _Shards(), {}
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["digest"] not in last:
                    if len(last) >= 4096:
                        last.clear()
                    data = shards.read(r["shard"], r["offset"], r["length"])
                    digest = hashlib.sha256(data).hexdigest()
                    if digest != r["digest"]:
                        raise ValueError(f"{r['shard']} at {r['offset']}: {digest} is not {r['digest']}")
                    payload = from_png(data)
                    last[digest] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), digest, features(payload, r["width"], r["height"]))
                rows.append((r["doc_id"], r["n_bytes"], *last[r["digest"]]))
            yield _table(out, rows)

    return described.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
