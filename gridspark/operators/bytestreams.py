"""Bytes: checksums, histograms, names, containers, and round trips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.layouts import ALIGNED_TO_RASTER


#: Bytes of a text that one row of sums stands for.
CHUNK = 1 << 16
# Fixed value: the modulus of Adler-32.
ADLER = 65_521


def adler32(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, adler): Adler-32 of texts' UTF-8 bytes in its closed form; null texts are empty. Keys must be distinct.

    With n bytes b_0 .. b_(n-1), its halves are 1 + sum(b_i) and n + sum((n - i) b_i).
    Texts are cut into chunks, each chunk gives its length, sum, and sum of
    b_i weighted by the distance to the chunk's end, and a text's chunks are added up.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.length("raw") / CHUNK).cast("int")), lambda k: F.struct((F.length("raw") - k * CHUNK).alias("left"), F.substring(F.col("raw"), k * CHUNK + 1, F.lit(CHUNK)).alias("piece")))
    pieces = df.select(key, raw.alias("raw")).select(key, F.explode(cuts).alias("c")).select(key, "c.left", "c.piece")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, weighted = [], []
            for piece in batch.column(2).to_pylist():
                b = np.frombuffer(piece, np.uint8).astype(np.int64)
                total.append(int(b.sum()))
                weighted.append(int((b * np.arange(len(b), 0, -1)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in batch.column(2).to_pylist()], pa.int64()), pa.array(total, pa.int64()), pa.array(weighted, pa.int64())], [key, "left", "n", "total", "weighted"])

    kind = df.schema[key].dataType.simpleString()
    sums = pieces.mapInArrow(kernel, f"`{key}` {kind}, left int, n long, total long, weighted long")
    low = F.lit(1) + F.sum("total")
    high = F.sum("n") + F.sum(F.col("weighted") + (F.col("left") - F.col("n")) % ADLER * F.col("total") % ADLER)
    return sums.groupBy(key).agg((low % ADLER + 65_536 * (high % ADLER)).cast("long").alias("adler"))


def byte_counts(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, byte, n): a histogram per batch inside the tasks, summed over all; null texts have no bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict = {}
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(np.frombuffer((text or "").encode(), np.uint8), minlength=256)
                counts[k] = counts[k] + n if k in counts else n
            rows = [(k, b, int(n[b])) for k, n in counts.items() for b in np.flatnonzero(n).tolist()]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], [key, "byte", "n"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text_col).mapInArrow(kernel, f"`{key}` {kind}, byte int, n long").groupBy(key, "byte").agg(F.sum("n").alias("n"))


def named(df: DataFrame, path: str, tie: str, extension: str) -> DataFrame:
    """df with name: the path with another extension, an underscore added for each earlier row of that name."""
    swapped = F.when(F.col(path).rlike(r"\.[^./]*$"), F.regexp_replace(path, r"\.[^./]*$", extension)).otherwise(F.concat(path, F.lit(extension)))
    rows = df.withColumn("_n", swapped)
    return rows.withColumn("name", F.concat("_n", F.repeat(F.lit("_"), F.row_number().over(Window.partitionBy("_n").orderBy(tie)) - 1))).drop("_n")


def sniffed(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("<!")), "doctype").when(F.startswith(text, F.lit("<h")), "html").otherwise("other")


def raw_blocks(blk: DataFrame) -> DataFrame:
    """(vec_id, batch, md5, equal): coefficients as big-endian 16-bit hex, and whether they read back."""
    word = lambda v: F.lpad(F.hex(bits.wrap16(v).cast("long")), 4, "0")
    rows = blk.withColumn("h", F.array_join(F.transform("coef", word), ""))
    read = F.transform(F.sequence(F.lit(0), F.lit(len(ALIGNED_TO_RASTER) - 1)), lambda i: F.conv(F.substring(F.col("h"), 4 * i + 1, F.lit(4)), 16, 10).cast("int"))
    signed = F.transform(read, lambda v: F.when(v >= 32768, v - 65536).otherwise(v))
    return rows.select("vec_id", bits.int_div(F.col("vec_id"), 1600).alias("batch"), F.md5("h").alias("md5"), (signed == F.col("coef")).alias("equal"))


def archive_prefix(version: Column, mode: Column, segments: Column, revision: Column, size: Column, metadata: Column) -> Column:
    """28 bytes: mark, version, mode, segments, padding, revision (24 hex digits), file size and metadata size."""
    return F.concat(F.unhex(F.lit("CF84")), bits.little_endian(version, 1), F.encode(mode, "UTF-8"), bits.little_endian(segments, 1), F.unhex(F.lit("000000")), F.unhex(revision), bits.little_endian(size), bits.little_endian(metadata))


def read_prefix(raw: Column) -> list[Column]:
    mode = F.decode(F.substring(raw, 4, 1), "UTF-8")
    named_mode = F.when(mode == "Z", "baseline").when(mode == "X", "progressive").otherwise("slice")
    return [bits.from_little_endian(raw, 21).alias("n_bytes"), bits.from_little_endian(raw, 5, 1).alias("segments"), named_mode.alias("mode")]


# -- round trips ----------------------------------------------------------------


def run_coded(df: DataFrame, key: str, order: list[str], bit_col: str) -> DataFrame:
    """(key, n_bits, ones, runs, equal): each key's bits in order as runs of equal bits, and whether the runs give them back.

    Runs are islands of one order; they are opened again to numbered bits, which
    are counted against the first ones.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.select(key, F.row_number().over(w).alias("_at"), F.col(bit_col).cast("int").alias("_bit"), F.coalesce((F.col(bit_col) != F.lag(bit_col).over(w)).cast("int"), F.lit(1)).alias("_new"))
    rows = rows.withColumn("_run", F.sum("_new").over(Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(key, "_run").agg(F.min("_at").alias("first"), F.count("*").alias("n"), F.min("_bit").alias("_bit"))
    back = runs.select(key, "_run", "_bit", F.explode(F.sequence(F.col("first").cast("long"), F.col("first") + F.col("n") - 1)).alias("_at"))
    mark = lambda side: F.lit(side).alias("_side")
    both = rows.select(key, "_run", F.col("_at").cast("long"), "_bit", mark(1)).unionByName(back.select(key, "_run", "_at", "_bit", mark(-1)))
    digest = F.sum(F.col("_side") * F.xxhash64("_at", "_bit").cast("decimal(38,0)"))
    real = F.col("_side") == 1
    return both.groupBy(key).agg(F.sum(real.cast("long")).alias("n_bits"), F.sum(F.when(real, F.col("_bit")).otherwise(0)).alias("ones"), F.max("_run").alias("runs"), ((digest == 0) & (F.sum("_side") == 0)).alias("equal"))


def stored(df: DataFrame, id_col: str, text_col: str, folder: str, codec: str = "zstd") -> DataFrame:
    """(id, n_bytes, md5, equal): texts written to folder as compressed Parquet, read again, and compared by size and digest.

    Null texts are stored as empty. Ids must be distinct.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    told = lambda x: [F.octet_length(x).cast("long").alias("n_bytes"), F.md5(x).alias("md5")]
    df.select(F.col(id_col).alias("id"), text.alias("text")).write.mode("overwrite").option("compression", codec).parquet(folder)
    back = df.sparkSession.read.parquet(folder).select("id", *told(F.col("text")))
    own = df.select(F.col(id_col).alias("id"), *(c.alias(f"own_{k}") for c, k in zip(told(text), ("n_bytes", "md5"), strict=True)))
    same = (F.col("n_bytes") == F.col("own_n_bytes")) & (F.col("md5") == F.col("own_md5"))
    return own.join(back, "id", "left").select("id", F.col("own_n_bytes").alias("n_bytes"), F.col("own_md5").alias("md5"), F.coalesce(same, F.lit(False)).alias("equal"))
