"""Asking the whole corpus about hashes, in packed form.

Documents are dealt to chunks of bounded size by a hash of their id. Each chunk sends, to the bucket of a hash, the
sorted distinct hashes that it holds as one packed row; the bucket answers each chunk with one packed row in the
same order; chunk and answers meet again by co-grouping on the exchange that dealt the chunks, which Spark reuses.
So a hash is sent once a chunk, however often the chunk has it, and no key's rows gather beyond one entry a chunk.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Bytes of text that a chunk has on average, at most.
CHUNK_BYTES = 8_000_000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def dealt(docs: DataFrame, id_col: str, text_col: str, n_bytes: int) -> tuple[DataFrame, int]:
    """(id, text as binary, chunk), dealt by chunk, and the number of chunks."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / CHUNK_BYTES))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    key = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    return own.withColumn("chunk", F.pmod(key, F.lit(n)).cast("int")).repartition(n, "chunk"), n


def texts(table) -> list[bytes]:
    """The binary column ``text`` of an Arrow table as views of its buffers."""
    out: list = []
    for part in table.column("text").chunks:
        wide = str(part.type) in ("large_binary", "large_string")
        offsets = np.frombuffer(part.buffers()[1], np.int64 if wide else np.int32)[part.offset : part.offset + len(part) + 1]
        data = memoryview(part.buffers()[2] or b"")
        out.extend(data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    return out


def mixed(h):
    """A bijection of 64 bits in which every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Prefixes:
    """Sums of a block's bytes from which the hash of any of its parts follows: independent of where the part lies."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def sums(self, b):
        if len(b) >= len(self.powers):
            n = len(b) + 1
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        out = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_TABLE[b] * self.powers[: len(b)], out=out[1:])
        return out

    def hashes(self, sums, starts, ends):
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def blocks(parts: list, size: int):
    """(first, bytes, starts): consecutive texts joined to blocks of about ``size`` bytes; a longer text is one alone."""
    i = 0
    while i < len(parts):
        j, n = i, 0
        while j < len(parts) and (j == i or n + len(parts[j]) <= size):
            n += len(parts[j])
            j += 1
        lengths = np.array([len(x) for x in parts[i:j]], np.int64)
        yield i, np.frombuffer(b"".join(parts[i:j]), np.uint8), np.concatenate([[0], np.cumsum(lengths)])
        i = j


def bucket_of(hashes, n: int):
    """Ascending with the hash, so that a sorted array falls into one slice a bucket."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def slices(hashes, n: int):
    """(bucket, from, to) of the buckets that sorted hashes have something in."""
    at = bucket_of(hashes, n)
    edges = np.flatnonzero(np.diff(at)) + 1
    lo = np.concatenate([[0], edges]) if len(at) else edges
    hi = np.concatenate([edges, [len(at)]]) if len(at) else edges
    return [(int(at[a]), int(a), int(b)) for a, b in zip(lo, hi)]


def _squeezed(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _unsqueezed(data: bytes, size: int):
    import pyarrow as pa

    return pa.Codec("zstd").decompress(data, size, asbytes=True)


def pack_sorted(values) -> bytes:
    """Ascending 64-bit numbers as differences: the low bytes, which are noise, as they are, byte by byte of all; the
    high ones, in which they are alike, compressed."""
    gaps = np.diff(values).astype("<u8")
    low = max(0, int(gaps.mean()).bit_length() - 1) // 8 if len(gaps) else 0
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return bytes([low]) + len(gaps).to_bytes(4, "little") + int(values[0]).to_bytes(8, "little") + planes[:low].tobytes() + _squeezed(planes[low:].tobytes())


def unpack_sorted(data: bytes):
    low, n = data[0], int.from_bytes(data[1:5], "little")
    planes = np.empty((8, n), np.uint8)
    planes[:low] = np.frombuffer(data, np.uint8, low * n, 13).reshape(low, n)
    planes[low:] = np.frombuffer(_unsqueezed(data[13 + low * n :], (8 - low) * n), np.uint8).reshape(8 - low, n)
    gaps = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(np.concatenate([[np.uint64(int.from_bytes(data[5:13], "little"))], gaps]), dtype=np.uint64)


def pack_counts(counts) -> bytes:
    """Counts of one byte, compressed, with those from 255 on written behind."""
    large = counts >= 255
    small = _squeezed(np.where(large, 255, counts).astype(np.uint8).tobytes())
    return len(counts).to_bytes(4, "little") + len(small).to_bytes(4, "little") + small + counts[large].astype("<u8").tobytes()


def unpack_counts(data: bytes):
    n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    out = np.frombuffer(_unsqueezed(data[8 : 8 + size], n), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=8 + size).astype(np.int64)
    return out


def chunked(docs: DataFrame, id_col: str, text_col: str, n_bytes: int, size: int) -> DataFrame:
    """(chunk, rows): the rows (id, text as binary) of ``docs`` where they are read, ``size`` bytes of text a chunk at
    most (a longer text is one alone), as a compressed Arrow stream; one row a chunk, dealt by chunk."""
    import pyarrow as pa

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        first, number = TaskContext.get().partitionId() << 32, 0
        held, n = [], 0

        def packed():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

        for batch in batches:
            ends = np.cumsum([len(x.as_buffer() or b"") for x in batch.column(1)]) if batch.num_rows else np.zeros(0, np.int64)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                upto = int(np.searchsorted(ends, before + size - n, side="right"))
                if upto == at and not held:
                    upto = at + 1  # a longer text
                if upto > at:
                    held.append(batch.slice(at, upto - at))
                    n += int(ends[upto - 1]) - before
                    at = upto
                if at < batch.num_rows:
                    yield packed()
                    held, n, number = [], 0, number + 1
        if held:
            yield packed()

    count = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / size))
    return map_batches(source, run, "chunk long, rows binary").repartition(count, "chunk")


def rows_of(table):
    """The rows (id, text) of the chunks in an Arrow table of (chunk, rows)."""
    import pyarrow as pa

    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("rows")])
