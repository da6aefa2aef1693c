"""What is refused, as data: each row carries its verdict, and no job fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bits
from . import blocks as B

# Markers of frames that aren't supported, and markers that can't stand among header segments.
UNSUPPORTED = (0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
MISPLACED = tuple(range(0xD0, 0xDA))
KNOWN = (0xC0, 0xC1, 0xC2, 0xC4, 0xDA, 0xDB, 0xDD, *range(0xE0, 0xF0), 0xFE)
#: Bits of a coefficient that can be coded; counts that a region can have.
MOST_BITS, MOST_INTERIOR, MOST_EDGE = 11, 49, 7


def is_image(raw: Column) -> Column:
    """Whether bytes begin as an image does."""
    return F.coalesce(F.hex(F.substring(raw, 1, 2)) == "FFD8", F.lit(False))


def marker_verdict(kind: Column) -> Column:
    return F.when(kind.isin(*UNSUPPORTED), "unsupported").when(kind.isin(*MISPLACED), "misplaced").when(kind.isin(*KNOWN), "ok").otherwise("unknown")


def header_verdict(raw: Column, kinds: Column) -> Column:
    """The first thing that a header is refused for; an unknown marker is only a warning, told if nothing is refused."""
    verdicts = F.transform(kinds, marker_verdict)
    first = F.get(F.filter(verdicts, lambda v: v.isin("unsupported", "misplaced")), 0)
    return F.when(~is_image(raw), "no image").otherwise(F.coalesce(first, F.when(F.array_contains(verdicts, "unknown"), "unknown").otherwise("ok")))


def block_verdict(coef: Column, interior: Column, row: Column, column: Column) -> Column:
    """Why a block with these told nonzero counts can't be: a count over its region, or a coefficient of too many bits."""
    wide = F.exists(coef, lambda v: bits.bit_length(v) > MOST_BITS)
    return F.when(interior > MOST_INTERIOR, "interior").when(row > MOST_EDGE, "row").when(column > MOST_EDGE, "column").when(wide, "magnitude").otherwise("ok")


def in_range(coef: Column, limits: list[int]) -> Column:
    """coef with zero for each value beyond its position's limit."""
    return F.zip_with(coef, B.array_of(limits), lambda v, most: F.when(F.abs(v) > most, 0).otherwise(v))


def wrapped_back(v: Column, predicted: Column) -> Column:
    """The value that comes back from a wrapped residual: v itself if it and the prediction are within 11 bits."""
    return bits.wrapped_residual(predicted + bits.wrapped_residual(v - predicted))


def numeric_text(s: Column) -> Column:
    """The number that a text of digits and dots holds; null for any other, a sign included."""
    return F.when(s.rlike(r"^[0-9]+(\.[0-9]*)?$|^\.[0-9]+$"), s.cast("double"))


def longest_run(symbols: Column) -> Column:
    """The longest run that a table of run-and-size symbols codes: 2 * 2**i - 1 for the largest i with a symbol of run i and size 0."""
    top = F.array_max(F.transform(F.filter(symbols, lambda s: (s % 16 == 0) & (s < 240)), lambda s: bits.int_div(s, 16)))
    return F.coalesce(F.pow(F.lit(2), top + 1).cast("long") - 1, F.lit(0).cast("long"))


def reciprocal_div(x: Column, d: Column, shift: int = 32) -> Column:
    """x div d by a multiplication and a shift; exact for x * d below 2**shift."""
    return F.shiftright(x * (bits.int_div(F.lit(1 << shift), d) + 1), shift)
