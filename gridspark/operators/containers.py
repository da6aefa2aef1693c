"""Containers as bytes: stored-block streams, grey-scale images, tagged records; and two models side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from . import ledger as L

# The largest stored chunk, and the first bytes of a stream.
MOST_STORED, STREAM_HEAD = 65_535, "7801"


def latin(raw: Column) -> Column:
    """Bytes as characters, one a byte, so that arrays of them join at once."""
    return F.decode(raw, "ISO-8859-1")


def joined(parts: Column) -> Column:
    """An array of bytes end to end."""
    return F.encode(F.array_join(F.transform(parts, latin), ""), "ISO-8859-1")


def stored_stream(raw: Column, adler: Column) -> Column:
    """A stream of stored chunks: each with a final mark, its size and the size's complement; the checksum, highest byte first, ends it."""
    n = F.length(raw)
    last = bits.int_div(F.greatest(n - 1, F.lit(0)), MOST_STORED).cast("int")

    def chunk(k: Column) -> Column:
        size = F.least(F.lit(MOST_STORED), n - k * MOST_STORED)
        return F.concat(F.unhex(F.when(k == last, "01").otherwise("00")), bits.little_endian(size, 2), bits.little_endian(MOST_STORED - size, 2), F.substring(raw, k * MOST_STORED + 1, F.lit(MOST_STORED)))

    return F.concat(F.unhex(F.lit(STREAM_HEAD)), joined(F.transform(F.sequence(F.lit(0), last), chunk)), bits.big_endian(adler, 4))


def stored_text(raw: Column) -> Column:
    """The bytes of a stored stream, by the sizes in its chunk headers."""
    start = F.struct(F.lit(3).alias("at"), F.lit(False).alias("done"), F.array().cast("array<binary>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        size = bits.from_little_endian(raw, at + 1, 2).cast("int")
        body = F.substring(raw, at + 5, size)
        return F.when(state["done"], state).otherwise(F.struct((at + 5 + size).alias("at"), (F.hex(F.substring(raw, at, F.lit(1))) == "01").alias("done"), F.concat(state["found"], F.array(body)).alias("found")))

    chunks = bits.int_div(F.length(raw), MOST_STORED) + 1  # all but the last are full
    return joined(F.aggregate(F.sequence(F.lit(1).cast("long"), chunks.cast("long")), start, step)["found"])


def grey_pixels(p: Column) -> Column:
    """Grey values of pixels scaled by 8 * 8192**2, around 128 and cut to a byte."""
    return F.transform(p, lambda x: bits.clamped(128 + bits.int_div(x, 8 * 8192 * 8192), 0, 255).cast("int"))


def grey_image(p: Column, width: int, height: int) -> Column:
    return F.concat(F.encode(F.lit(f"P5 {width} {height} 255\n"), "UTF-8"), F.unhex(F.array_join(F.transform(p, lambda x: F.lpad(F.hex(x), 2, "0")), "")))


RECORD = "struct<tag:string,body:binary>"


def record(tag: str, body: Column) -> Column:
    """Three letters, the size in four bytes, lowest first, and the body."""
    return F.concat(F.encode(F.lit(tag), "UTF-8"), bits.little_endian(F.length(body), 4), body)


def records(raw: Column) -> Column:
    """The records of a container as an array of {tag, body}; it ends early where a size runs over the end. A record takes seven bytes at least."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{RECORD}>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        size = bits.from_little_endian(raw, at + 3, 4).cast("int")
        item = F.struct(F.decode(F.substring(raw, at, F.lit(3)), "UTF-8").alias("tag"), F.substring(raw, at + 7, size).alias("body")).cast(RECORD)
        fits = F.coalesce(at + 6 + size <= F.length(raw), F.lit(False))
        return F.when(fits, F.struct((at + 7 + size).alias("at"), F.concat(state["found"], F.array(item)).alias("found"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), (bits.int_div(F.length(raw), 7) + 1).cast("long")), start, step)["found"]


def compared(own: DataFrame, other: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, p, other, differs): the probabilities that two models' counts imply for each slot of the first; null where the other lacks it."""
    p = lambda df, name: df.select(*keys, L.implied(F.col("f"), F.col("t")).alias(name))
    both = p(own, "p").join(p(other, "other"), keys, "left")
    return both.withColumn("differs", F.abs(F.col("p") - F.col("other")) > most)
