"""Operators on blocks of 64 coefficients in aligned order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.layouts import ALIGNED_TO_RASTER, COLUMN, COSINE, COUNT_BINS, DC, FREQUENCY_MAX, NOISE_FLOOR, QUANT, RASTER_TO_ALIGNED, ROW


def array_of(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def nonzeros(coef: Column, first: int, n: int) -> Column:
    return F.size(F.filter(F.slice(coef, first + 1, n), lambda x: x != 0))


def furthest(coef: Column, axis: str) -> Column:
    """The largest column ('x') or row ('y') of a nonzero interior coefficient; 0 without any."""
    place = [r % 8 if axis == "x" else r // 8 for r in ALIGNED_TO_RASTER[:49]]
    return F.array_max(F.zip_with(F.slice(coef, 1, 49), array_of(place), lambda v, p: F.when(v != 0, p).otherwise(0)))


def last_nonzero(coef: Column) -> Column:
    """The last position that isn't zero; 0 without any."""
    return F.array_max(F.transform(coef, lambda v, i: F.when(v != 0, i).otherwise(0)))


def permuted(coef: Column, order: list[int]) -> Column:
    return F.transform(array_of(order), lambda i: F.get(coef, i))


def position_class(pos: Column) -> Column:
    return F.when(pos < DC, "7x7").when(pos == DC, "dc").otherwise("edge")


def with_neighbours(blk: DataFrame, **columns: Column) -> DataFrame:
    """blk with left_, above_ and corner_ of each named column: the values of the blocks to the left, above, and both.

    Null where the image has no such block. Two windows, by row and by column
    of an image; the corner is the row above's left value.
    """
    row = Window.partitionBy("image_id", "by").orderBy("bx")
    column = Window.partitionBy("image_id", "bx").orderBy("by")
    out = blk.withColumns(columns)
    near = F.lag("bx").over(row) == F.col("bx") - 1
    out = out.withColumns({f"left_{k}": F.when(near, F.lag(k).over(row)) for k in columns})
    over = F.lag("by").over(column) == F.col("by") - 1
    return out.withColumns({f"above_{k}": F.when(over, F.lag(k).over(column)) for k in columns} | {f"corner_{k}": F.when(over, F.lag(f"left_{k}").over(column)) for k in columns})


def weighted_magnitude(left: Column, above: Column, corner: Column) -> Column:
    """(13 |left| + 13 |above| + 6 |corner|) / 32 over 16 bits; a single neighbour's magnitude; 0 for none."""
    both = left.isNotNull() & above.isNotNull()
    mix = bits.wrap16(13 * (F.abs(left) + F.abs(above)) + 6 * F.abs(corner))
    return F.when(both, F.shiftright(mix, 5)).otherwise(F.coalesce(F.abs(left), F.abs(above), F.lit(0)))


def count_context(left: Column, above: Column) -> Column:
    """Expected nonzero count from the neighbours' counts, rounded; half of a single one's; 0 for none."""
    both = left.isNotNull() & above.isNotNull()
    return F.when(both, bits.int_div(left + above + 2, 4)).otherwise(bits.int_div(F.coalesce(left, above, F.lit(-1)) + 1, 2)).cast("int")


def count_bin(n: Column) -> Column:
    return bits.count_bin(n, COUNT_BINS)


def median_edge(left: Column, above: Column, corner: Column) -> Column:
    """The median-edge predictor; with one neighbour that neighbour, without any 0."""
    both = left.isNotNull() & above.isNotNull()
    lo, hi = F.least(left, above), F.greatest(left, above)
    full = F.when(corner >= hi, lo).when(corner <= lo, hi).otherwise(left + above - corner)
    return F.when(both, full).otherwise(F.coalesce(left, above, F.lit(0)))


def edge_prediction(coef: Column, other: Column, band: int, across: bool) -> Column:
    """An edge coefficient predicted from the neighbour above (across) or to the left.

    ``band`` is the frequency along the edge, 1 to 7. The neighbour's and the
    block's own seven further coefficients of the band are weighed by the
    dequantised cosines of the shared edge; the division drops the fraction.
    """
    at = [band + 8 * i if across else 8 * band + i for i in range(8)]
    weight = [COSINE[i][0] * QUANT[r] for i, r in enumerate(at)]
    here, there = ([F.get(c, RASTER_TO_ALIGNED[r]).cast("long") for r in at] for c in (coef, other))
    total = there[0] * weight[0]
    for i in range(1, 8):
        total = total - weight[i] * (here[i] + (there[i] if i % 2 else -there[i]))
    return bits.int_div(total, weight[0])


def once(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda's variable isn't computed again where it is used, an expression is."""
    return F.get(F.transform(F.array(value), f), 0)


def pixels(coef: Column) -> Column:
    """The inverse transform, unrounded, scaled by 8 * 8192**2: 64 integers in raster order."""
    rows = [[F.get(coef, RASTER_TO_ALIGNED[8 * v + u]).cast("long") for u in range(8)] for v in range(8)]
    # Rows first: one array per row of frequencies, then the columns of those.
    half = F.array(*(F.array(*(sum((rows[v][u] * COSINE[u][x] for u in range(1, 8)), rows[v][0] * COSINE[0][x]) for x in range(8))) for v in range(8)))
    basis = F.array(*(F.array(*(F.lit(COSINE[v][y]).cast("long") for v in range(8))) for y in range(8)))
    whole = lambda h: F.flatten(F.transform(basis, lambda by: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: F.aggregate(F.zip_with(h, by, lambda row, w: F.get(row, x) * w), F.lit(0).cast("long"), lambda a, b: a + b))))
    return once(half, whole)


def quant_table(spark) -> DataFrame:
    """(pos, q, limit, limit_bits, noise): the quantiser and range of each aligned position, 64 rows."""
    rows = []
    for pos, r in enumerate(ALIGNED_TO_RASTER):
        limit = (FREQUENCY_MAX[r] + QUANT[r] - 1) // QUANT[r]
        rows.append((pos, QUANT[r], limit, limit.bit_length(), max(0, limit.bit_length() - NOISE_FLOOR)))
    return spark.createDataFrame(rows, "pos int, q int, `limit` int, limit_bits int, noise int")


EDGE_COUNTS = {"row": (ROW.start, 7), "column": (COLUMN.start, 7)}


# -- the DC coefficient from the neighbours' pixels -------------------------------

#: Pixels are eight times their value here, so 128, the middle, is 1024.
MIDDLE = 1024


def pixels_without_dc(coef: Column) -> Column:
    """64 pixels in raster order, eight times their value, as if DC were 0."""
    without = F.transform(coef, lambda v, i: F.when(i == DC, 0).otherwise(v))
    return F.transform(pixels(without), lambda p: bits.int_div(p, 8192 * 8192))


def half(v: Column) -> Column:
    """Half of v, cut towards zero."""
    return bits.int_div(v, 2)


def edge_pixels(p: Column, dc: Column) -> Column:
    """{right, below}: the pixels expected just beyond a block, its last ones carried on by half their last step; dc is dequantised."""

    def beyond(at, before) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: dc + F.get(p, at(i)) + MIDDLE + half(F.get(p, at(i)) - F.get(p, before(i))))

    return F.struct(beyond(lambda i: 8 * i + 7, lambda i: 8 * i + 6).alias("right"), beyond(lambda i: 56 + i, lambda i: 48 + i).alias("below"))


def dc_from_pixels(p: Column, left: Column, above: Column, quantiser: int) -> Column:
    """{predicted, spread, offset} of the quantised DC from the eight pixels beyond the left and upper blocks; a null side is absent.

    Each pixel on a shared edge gives an estimate. Their mean is the prediction;
    an eighth of their range, and of the smaller distance of a side's sum from the
    mean of both sums, tell how sure it is. Without neighbours all are 0.
    """

    def estimates(side: Column, at, after) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get(side, i) - half(F.get(p, at(i)) - F.get(p, after(i))) - F.get(p, at(i)) - MIDDLE)

    none = F.array().cast("array<bigint>")
    by_left = F.when(left.isNotNull(), estimates(left, lambda i: 8 * i, lambda i: 8 * i + 1)).otherwise(none)
    by_above = F.when(above.isNotNull(), estimates(above, lambda i: i, lambda i: i + 8)).otherwise(none)
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    every = F.concat(by_left, by_above)
    one, other = add(F.when(left.isNotNull(), by_left).otherwise(by_above)), add(F.when(above.isNotNull(), by_above).otherwise(by_left))
    mean = F.shiftright(one + other, 1)
    far = F.when(F.abs(one - mean) < F.abs(other - mean), one - mean).otherwise(other - mean)
    spread = F.coalesce(F.shiftright(F.array_max(every) - F.array_min(every), 3), F.lit(0).cast("long"))
    return F.struct(F.shiftright(bits.int_div(mean, quantiser) + 4, 3).alias("predicted"), spread.alias("spread"), F.shiftright(far, 3).alias("offset"))
