"""Helpers that the operators share: row shipping, hashing, bucket counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from ..sources.shared import checkpointed

#: Stands for a null id inside the kernels; results carry the null again.
NULL_ID = -(2**63)
#: Bytes of text that one bucket or partition of the kernels is sized for.
BUCKET_BYTES = 16 << 20


def bucket_count(df: DataFrame, text_col: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets that hold about bucket_bytes of text each; never fewer than the shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, -(-total // bucket_bytes), 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds) over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The partition in which a row with this int64 id meets what was found about it."""
    return (mixed(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def integer_id(df: DataFrame, id_col: str) -> Column:
    """The id column as long; an error if it holds no integers."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")
    return F.col(id_col).cast("long")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., which clash with nothing that an operator adds."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def without_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df less its columns of these names, in capitals or not, as Spark resolves them."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def id_array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of every window, from prefix sums; the tables grow on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.zeros(0, np.uint64)

    def windows(self, units: np.ndarray, width: int) -> np.ndarray:
        """Hash of units[i:i+width] for every i; units are uint64."""
        n = len(units)
        if n < width:
            return np.zeros(0, np.uint64)
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * self.up[:n], out=sums[1:])
        return (sums[width:] - sums[:-width]) * self.down[: n - width + 1]


# -- numpy arrays and Arrow rows as binary payloads ---------------------------


def planes(x: np.ndarray) -> bytes:
    """The bytes of x plane by plane, so that a block compressor sees runs of equal high bytes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: memoryview, dtype: type, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(dtype).reshape(n)


def packed(*arrays: np.ndarray) -> bytes:
    """The number of arrays and their lengths, then each array in planes."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.uint32).tobytes()
    return head + b"".join(planes(a) for a in arrays)


def unpacked(raw: bytes, *dtypes: type) -> list[np.ndarray]:
    """The first arrays of a payload, as many as dtypes are given."""
    view, out = memoryview(raw), []
    at = 4 + 4 * int(np.frombuffer(view[:4], np.uint32)[0])
    for n, kind in zip(np.frombuffer(view[4:at], np.uint32).tolist(), dtypes, strict=False):
        size = n * np.dtype(kind).itemsize
        out.append(unplanes(view[at : at + size], kind, n))
        at += size
    return out


def squeezed(raw: bytes) -> bytes:
    """raw after its length, entropy-coded: a shuffle's own codec only finds repeats."""
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(raw: bytes) -> bytes:
    return pa.decompress(memoryview(raw)[8:], int(np.frombuffer(raw, np.int64, 1)[0]), "zstd", asbytes=True)


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])


PACKED = "part int, payload binary"
_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))


def batch_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_IPC) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def shipped(df: DataFrame, id_col: str, parts: int) -> DataFrame:
    """All columns of df, as compressed Arrow payloads in partition part_of(id): one per batch and partition, at most as many as rows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            part = part_of(id_array(table.column(id_col)), parts)
            order = np.argsort(part, kind="stable")
            table, part = table.take(pa.array(order)), part[order]
            starts, ends = runs(part)
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), pa.array([batch_bytes(table.slice(a, b - a))], pa.binary())], ["part", "payload"])

    return df.mapInArrow(kernel, PACKED).repartitionById(parts, F.col("part"))


def unshipped(payloads: pa.ChunkedArray | pa.Array) -> Iterator[pa.Table]:
    for raw in payloads:
        yield pa.ipc.open_stream(raw.as_py()).read_all()


def gathered(batches: Iterator[pa.RecordBatch], limit: int = 32 << 20) -> Iterator[pa.Table]:
    """Arrow batches joined up to about limit bytes."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
