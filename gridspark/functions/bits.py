"""Bit, byte and number functions as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | int | str) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def bit_length(v: Column) -> Column:
    """Bits that hold the magnitude; 0 for 0. (SQL's own bit_length counts the bits of a string.)"""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("long")))).cast("int")


def floor_log2(v: Column) -> Column:
    return bit_length(v) - 1


def to_envelope(v: Column, size: Column) -> Column:
    """Sign-magnitude bits of v in a size class: v itself, or v - 1 + 2**size below zero."""
    return F.when(v > 0, v).otherwise(v - 1 + F.pow(F.lit(2), size).cast("long")).cast("long")


def from_envelope(n: Column, size: Column) -> Column:
    top = F.pow(F.lit(2), size - 1).cast("long")
    return F.when(size == 0, F.lit(0)).when(n >= top, n).otherwise(n + 1 - 2 * top).cast("long")


def clamped(v: Column, lo: int, hi: int) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def truncating_shift(v: Column, n: int) -> Column:
    """v / 2**n towards zero; a shift of a negative number would floor."""
    return F.signum(v).cast("long") * F.shiftright(F.abs(v).cast("long"), n)


def bit_field(v: Column, low: int, width: int) -> Column:
    return F.shiftright(v, low).bitwiseAND(F.lit((1 << width) - 1))


def count_bin(n: Column, starts: Sequence[int]) -> Column:
    """The bin of a count, bins given by their first values."""
    out = F.lit(0)
    for k, start in enumerate(starts):
        out = F.when(n >= start, k).otherwise(out)
    return out.cast("int")


def wrap16(v: Column) -> Column:
    return v.bitwiseAND(F.lit(65535))


def wrapped_residual(v: Column, bits: int = 11) -> Column:
    """v brought into [-2**(bits-1), 2**(bits-1)] by one step of 2**bits + 1."""
    top = 1 << (bits - 1)
    return F.when(v < -top, v + 2 * top + 1).when(v > top, v - 2 * top - 1).otherwise(v)


def little_endian(v: Column, size: int = 4) -> Column:
    """Unsigned value as size bytes, lowest first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(bit_field(v.cast("long"), 8 * k, 8)), 2, "0") for k in range(size))))


def from_little_endian(b: Column, at: int = 1, size: int = 4) -> Column:
    total = F.lit(0).cast("long")
    for k in range(size):
        total = total + F.conv(F.hex(F.substring(b, at + k, 1)), 16, 10).cast("long") * F.lit(1 << (8 * k))
    return total


def big_endian(v: Column, size: int = 2) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(bit_field(v.cast("long"), 8 * k, 8)), 2, "0") for k in reversed(range(size)))))


def from_big_endian(b: Column, at: int = 1, size: int = 2) -> Column:
    return F.conv(F.hex(F.substring(b, at, size)), 16, 10).cast("long")


def stuffed(b: Column, byte: int, filler: int = 0) -> Column:
    """b with filler after each given byte. Latin-1 maps bytes to characters one to one, so nothing is misaligned."""
    s = F.decode(b, "ISO-8859-1")
    return F.encode(F.replace(s, F.lit(chr(byte)), F.lit(chr(byte) + chr(filler))), "ISO-8859-1")


def unstuffed(b: Column, byte: int, filler: int = 0) -> Column:
    s = F.decode(b, "ISO-8859-1")
    return F.encode(F.replace(s, F.lit(chr(byte) + chr(filler)), F.lit(chr(byte))), "ISO-8859-1")


def size_literal(s: Column) -> Column:
    """Bytes of '123', '16K' or '4M'; null for over 16 digits or any other form."""
    n = F.regexp_extract(s, r"^(\d{1,16})[KM]?$", 1)
    factor = F.when(s.endswith("M"), F.lit(1 << 20)).when(s.endswith("K"), F.lit(1 << 10)).otherwise(F.lit(1))
    return F.when(n != "", n.cast("long") * factor)


def time_literal_ms(s: Column) -> Column:
    """Milliseconds of '<n>s', '<n>ms' or '<n>us'; null otherwise."""
    n = F.regexp_extract(s, r"^(\d{1,16})(s|ms|us)$", 1)
    unit = F.regexp_extract(s, r"^(\d{1,16})(s|ms|us)$", 2)
    return F.when(unit == "s", n.cast("long") * 1000).when(unit == "ms", n.cast("long")).when(unit == "us", F.floor(n.cast("long") / 1000))


def percent(part: Column, whole: Column) -> Column:
    """part / whole as a percentage, cut to two decimals."""
    return F.when(whole != 0, F.floor(part * F.lit(10000) / whole) / F.lit(100.0))


def next_power_of_two(v: Column) -> Column:
    """The least power of two from v on, for v over 1; 1 otherwise."""
    return F.when(v <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2), bit_length(v - 1)).cast("long"))


def ceil_div(a: Column, b: Column | int) -> Column:
    """For a from 0 on and b over 0."""
    return F.floor((a + _c(b) - 1) / _c(b)).cast("long")


def int_div(a: Column, b: Column | int) -> Column:
    """Division that drops the fraction, as SQL's div."""
    return F.call_function("div", a, _c(b))
