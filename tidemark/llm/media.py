"""Media columns: payloads as content-addressed PNG images in tar shards.

A payload (bytes) is filled up with 255 to a positive multiple of 576 and stored as an 8-bit grey image 576 samples
wide, one row for each 576 bytes, which is lossless and compresses. Each task appends its images to tar shards under
the SHA-256 of the payload; a payload that a shard already holds is not stored again, so copies in a shard share one
member. Rows carry shard, offset and length. Width and height are then read from the 33 header bytes alone.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textcore

WIDTH = 576
#: A shard is closed when it holds so many bytes.
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """A grey PNG of the payload's bytes; its length must be a positive multiple of 576."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a first byte of 0: the row is stored as it is
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from a PNG's first 33 bytes."""
    if len(head) < HEADER_BYTES or not head.startswith(_SIGNATURE) or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    """The payload of a PNG that encode_png made."""
    width, height, bits = read_header(data[:HEADER_BYTES])
    if (width, bits) != (WIDTH, 8):
        raise ValueError("not one of these images")
    at, body = len(_SIGNATURE), b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def _store(folder: str) -> Callable:
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tar = out = name = None
        at, held = 0, {}
        for batch in batches:
            data, offs = textcore.buffers(batch.column(1))
            data = data.tobytes()
            rows = []
            for i in range(batch.num_rows):
                raw = data[offs[i] : offs[i + 1]]
                payload = pad(raw)
                digest = hashlib.sha256(payload).hexdigest()
                if tar is not None and at >= SHARD_BYTES:
                    tar.close()
                    out.close()
                    tar = None
                if tar is None:
                    # Each attempt writes shards of its own; the index, which is committed, names those that count.
                    name, at, held = f"{folder}/shard-{uuid.uuid4().hex}.tar", 0, {}
                    out = common.open_out(name)
                    tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT, bufsize=1 << 16)
                if digest not in held:
                    image = encode_png(payload)
                    member = tarfile.TarInfo(f"{digest}.png")
                    member.size = len(image)
                    tar.addfile(member, io.BytesIO(image))
                    held[digest] = (at + 512, len(image))
                    at += 512 + len(image) + -len(image) % 512
                rows.append((len(raw), digest, name, *held[digest]))
            n, digests, names, offsets, lengths = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "n_bytes", "digest", "shard", "offset", "length"],
            )
        if tar is not None:
            tar.close()
            out.close()

    return store


def store_payloads(df: DataFrame, folder: str, *, key: str = "doc_id", payload: str = "text") -> DataFrame:
    """Store each row's payload; returns the index ``key, n_bytes, digest, shard, offset, length``, written.

    A null or empty payload is stored as 576 bytes of 255. Null and repeated keys keep their rows; an empty table
    makes no shard. Payloads are stored whole. Other columns are ignored.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(payload).cast("string").alias("payload"))
    made = rows.mapInArrow(_store(folder), "key long, n_bytes long, digest string, shard string, offset long, length long")
    return common.written(made, f"{folder}/index.parquet").withColumnRenamed("key", key)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple, tuple] = {}
        opened = ("", None)
        for place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if place not in seen:
                if opened[0] != place[0]:
                    opened = (place[0], common.open_in(place[0]))
                opened[1].seek(place[1])
                seen[place] = read_header(opened[1].read(HEADER_BYTES))
        got = [seen[p] for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        columns = [pa.array([g[i] for g in got], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "width", "height", "bits"])


def with_headers(index: DataFrame) -> DataFrame:
    """Adds width, height and bits of a sample to an index, by range reads of 33 bytes."""
    rest = [c for c in index.columns if c not in ("shard", "offset")]
    rows = index.select("shard", "offset", *rest)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_headers, f"{kinds}, width int, height int, bits int")


def feature(payload: bytes) -> str:
    """Mean, deviation and mean step of the samples, three decimals each."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n = len(x)
    mean = int(x.sum()) / n
    var = max(0.0, int((x * x).sum()) / n - mean * mean)
    step = int(np.abs(np.diff(x)).sum()) / max(1, n - 1)
    return f"mean={mean:.3f};dev={var**0.5:.3f};step={step:.3f}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, seen = ("", None), {}
    for batch in batches:
        out = []
        for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
            if opened[0] != shard:
                opened, seen = (shard, common.open_in(shard)), {}
            if offset not in seen:
                opened[1].seek(offset)
                image = opened[1].read(length)
                payload = decode_png(image)
                seen[offset] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload))
            out.append(seen[offset])
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), *columns, *(batch.column(c) for c in ("shard", "offset", "width", "height"))], names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height"])


def read_features(index: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Reads each stored image back and computes its digests and its feature; one row for each row of the index.

    Of a shard, a member that many rows share is read once in a task, if its rows follow each other."""
    rows = with_headers(index.withColumnRenamed(key, "key"))
    out = rows.mapInArrow(_features, "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, width int, height int")
    return out.withColumnRenamed("key", key)
