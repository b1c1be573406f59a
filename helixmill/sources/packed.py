"""Packed base files: reads of 2 or 4 bits a base after a 16-bit length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

from helixmill.functions.flat import flat_text, ranges, slices

#: Codes of the packed formats.
TWO_BIT, FOUR_BIT = "AGCT", "AGCTN"
LONGEST = 65535


def _format(with_n: bool) -> tuple[str, int, int]:
    """Letters, bits of one and letters in a byte."""
    return (FOUR_BIT, 4, 2) if with_n else (TWO_BIT, 2, 4)


def pack_column(seqs: pa.Array, with_n: bool = False) -> pa.Array:
    """Each read as its length in two bytes (low first), then bases from the low bits up; all reads of a batch at once."""
    order, bits, per = _format(with_n)
    flat, offsets = flat_text(seqs)
    size, table = np.diff(offsets), np.full(256, 255, np.uint8)
    if (size > LONGEST).any():
        raise ValueError("packed reads have at most 65535 bases")
    table[list(order.encode())] = range(len(order))
    code = table[flat]
    if (code == 255).any():
        raise ValueError("illegal base")
    room = -(-size // per)
    padded = np.zeros(int(room.sum()) * per, np.uint8)
    padded[ranges((np.cumsum(room) - room) * per, size)[0]] = code
    body = np.bitwise_or.reduce(padded.reshape(-1, per) << np.arange(0, 8, bits, dtype=np.uint8), axis=1).astype(np.uint8)
    start = np.append(0, np.cumsum(room + 2))
    out = np.empty(int(start[-1]), np.uint8)
    out[start[:-1]], out[start[:-1] + 1] = size & 255, size >> 8
    out[ranges(start[:-1] + 2, room)[0]] = body
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(start.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def unpack_column(packed: pa.Array, with_n: bool = False) -> pa.Array:
    """The reads of ``pack_column``."""
    order, bits, per = _format(with_n)
    flat, offsets = flat_text(packed)
    size = flat[offsets[:-1]].astype(np.int64) | flat[offsets[:-1] + 1].astype(np.int64) << 8
    room = -(-size // per)
    body = flat[ranges(offsets[:-1] + 2, room)[0]]
    code = ((body[:, None] >> np.arange(0, 8, bits, dtype=np.uint8)) & ((1 << bits) - 1)).ravel()
    letters = np.frombuffer((order + "?" * (16 - len(order))).encode(), np.uint8)
    bases = letters[code[ranges((np.cumsum(room) - room) * per, size)[0]]]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32).tobytes()), pa.py_buffer(bases.tobytes()))


def pack_batches(batches: Iterable[pa.RecordBatch], with_n: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "seq", 1 << 20):
        yield pa.RecordBatch.from_arrays([batch.column("read_idx"), pack_column(batch.column("seq"), with_n)], ["read_idx", "packed"])


def unpack_batches(batches: Iterable[pa.RecordBatch], with_n: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "packed", 1 << 18):
        yield pa.RecordBatch.from_arrays([batch.column("read_idx"), unpack_column(batch.column("packed"), with_n)], ["read_idx", "seq"])


def write(reads: DataFrame, path: str, with_n: bool = False) -> None:
    """A packed file: one row (``read_idx``, ``packed``) a read. Reads of other letters, or too long, raise."""
    reads.where("seq is not null").select("read_idx", "seq").mapInArrow(lambda it: pack_batches(it, with_n), "read_idx bigint, packed binary").write.mode("overwrite").parquet(path)


def scan(spark: SparkSession, path: str, with_n: bool = False) -> DataFrame:
    """The reads (``read_idx``, ``seq``) of a packed file."""
    return spark.read.parquet(path).select("read_idx", "packed").mapInArrow(lambda it: unpack_batches(it, with_n), "read_idx bigint, seq string")


def pack_read(seq: str, with_n: bool = False) -> bytes:
    return pack_column(pa.array([seq]), with_n)[0].as_py()


def unpack_reads(data: bytes, with_n: bool = False) -> Iterator[str]:
    """The reads of packed bytes put end to end."""
    order, bits, per = _format(with_n)
    at = 0
    letters = np.frombuffer((order + "?" * (16 - len(order))).encode(), np.uint8)
    while at < len(data):
        n = int.from_bytes(data[at : at + 2], "little")
        size = -(-n // per)
        body = np.frombuffer(data, np.uint8, size, at + 2)
        code = (body[:, None] >> np.arange(0, 8, bits, dtype=np.uint8)) & ((1 << bits) - 1)
        yield letters[code.ravel()[:n]].tobytes().decode()
        at += 2 + size
