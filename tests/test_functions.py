"""Scalar functions against Python, over whole ranges or random values."""

import random
import zlib

from pyspark.sql import functions as F

from gridspark.functions import bits, layouts
from gridspark.operators import bytestreams, ledger


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_bit_length_all_16_bit_values(spark):
    df = spark.range(-32768, 32768, numPartitions=4).select(F.col("id").alias("v"))
    got = {r.v: (r.n, r.l) for r in df.select("v", bits.bit_length(F.col("v")).alias("n"), bits.floor_log2(F.col("v")).alias("l")).collect()}
    assert all(got[v] == (abs(v).bit_length(), abs(v).bit_length() - 1) for v in got)


def test_envelopes_round_trip(spark):
    df = spark.range(-2047, 2048).select(F.col("id").alias("v")).withColumn("s", bits.bit_length(F.col("v"))).withColumn("e", bits.to_envelope(F.col("v"), F.col("s")))
    rows = df.withColumn("back", bits.from_envelope(F.col("e"), F.col("s"))).collect()
    assert all(r.back == r.v and 0 <= r.e < max(1, 1 << r.s) for r in rows)


def test_shifts_and_fields_of_negatives(spark):
    df = spark.range(-70, 71).select(F.col("id").alias("v"))
    rows = df.select("v", bits.truncating_shift(F.col("v"), 2).alias("a"), bits.int_div(F.col("v"), 7).alias("b"), bits.wrap16(F.col("v")).alias("c"), bits.wrapped_residual(F.col("v"), 6).alias("d")).collect()
    for r in rows:
        assert r.a == int(r.v / 4) and r.b == int(r.v / 7) and r.c == r.v % 65536
        assert -32 <= r.d <= 32 or abs(r.v) > 97
        assert (r.d - r.v) % 65 == 0


def test_byte_orders(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 255, 256, 65535, 65536, 2**31, 2**32 - 1)], "v long")
    rows = df.select("v", bits.little_endian(F.col("v")).alias("l"), bits.big_endian(F.col("v"), 4).alias("b")).select("v", "l", "b", bits.from_little_endian(F.col("l")).alias("x"), bits.from_big_endian(F.col("b"), 1, 4).alias("y")).collect()
    for r in rows:
        assert bytes(r.l) == r.v.to_bytes(4, "little") and bytes(r.b) == r.v.to_bytes(4, "big") and r.x == r.y == r.v


def test_stuffing_any_bytes(spark):
    rng = random.Random(5)
    raws = [bytes(rng.choice([0, 1, 254, 255, 65]) for _ in range(n)) for n in range(40)]
    df = spark.createDataFrame([(bytearray(r),) for r in raws], "b binary").select("b", bits.stuffed(F.col("b"), 255).alias("s"))
    for r in df.select("b", "s", bits.unstuffed(F.col("s"), 255).alias("u")).collect():
        assert bytes(r.s) == bytes(r.b).replace(b"\xff", b"\xff\x00") and r.u == r.b


def test_literals(spark):
    df = spark.createDataFrame([("123",), ("16K",), ("4M",), ("4G",), ("",), ("12345678901234567",), ("-1",), (None,)], "s string")
    assert column(df, bits.size_literal(F.col("s"))) == [123, 16384, 4194304, None, None, None, None, None]
    df = spark.createDataFrame([("5s",), ("7ms",), ("1500us",), ("5m",), (None,)], "s string")
    assert column(df, bits.time_literal_ms(F.col("s"))) == [5000, 7, 1, None, None]


def test_next_power_of_two(spark):
    df = spark.range(0, 300).select(F.col("id").alias("v"))
    for r in df.select("v", bits.next_power_of_two(F.col("v")).alias("p")).collect():
        assert r.p == (1 if r.v <= 1 else 1 << (r.v - 1).bit_length())


def test_orders_are_permutations():
    for order in (layouts.ZIGZAG_TO_RASTER, layouts.ALIGNED_TO_RASTER, layouts.RASTER_TO_ALIGNED, layouts.ZIGZAG_TO_ALIGNED):
        assert sorted(order) == list(range(64))
    assert layouts.ZIGZAG_TO_RASTER[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert layouts.ALIGNED_TO_RASTER[:2] == [9, 10] and layouts.ALIGNED_TO_RASTER[49:51] == [0, 1]


def test_adler32(spark):
    texts = ["", "a", "Wörter " * 999, None]
    texts += ["\xff" * 100_000, "x" * 65_536]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert dict(map(tuple, bytestreams.adler32(df, "k", "t").collect())) == {k: zlib.adler32((t or "").encode()) for k, t in enumerate(texts)}


def test_adaptive_state_saturates(spark):
    bits_ = [0] * 300 + [1] + [0] * 300
    rows = [(k, i, b) for k in (1, 2, 3) for i, b in enumerate(bits_[: 200 * k + 1])]
    got = {r.k: (r.n, r.f, r.t, r.p) for r in ledger.adapted(spark.createDataFrame(rows, "k int, i int, b int"), "k", ["i"], "b").collect()}
    assert got[3] == (601, 255, 1, 255)
    for k in got:
        f, t, p = 1, 1, 128
        for b in bits_[: 200 * k + 1]:
            f, t, p = ledger.observed(f, t, b)
        assert got[k] == (200 * k + 1, f, t, p)
    assert ledger.adapted(spark.createDataFrame([], "k int, i int, b int"), "k", ["i"], "b").count() == 0
