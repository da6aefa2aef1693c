"""Bit ledgers, reports on them, and adaptive probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits

# The categories that a bit is billed to, by the subtotal they belong to.
CATEGORIES = {
    "misc": ["HEADER", "DELIMITERS"],
    "none": ["RESERVED"],
    "7x7": ["NZ_7x7", "BITMAP_7x7", "EXP1_7x7", "EXP2_7x7", "EXP3_7x7", "EXPN_7x7", "SIGN_7x7", "RES_7x7"],
    "edge": ["NZ_EDGE", "BITMAP_EDGE", "EXP1_EDGE", "EXP2_EDGE", "EXP3_EDGE", "EXPN_EDGE", "SIGN_EDGE", "RES_EDGE"],
    "dc": ["EXP0_DC", "EXP1_DC", "EXP2_DC", "EXP3_DC", "EXPN_DC", "SIGN_DC", "RES_DC"],
}
NAMES = [c for group in CATEGORIES.values() for c in group]


def category(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), (number % len(NAMES)).cast("int") + 1)


def group_of(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for group, names in CATEGORIES.items():
        out = F.when(name.isin(*names), group).otherwise(out)
    return out


def billed(df: DataFrame, *keys: str, bits_col: str = "bits") -> DataFrame:
    """Sum of bits by category and side; a partial aggregate per task, so every writer's entries are combined where they arise."""
    return df.groupBy(*keys, "category", "is_compressed").agg(F.sum(bits_col).alias("bits"))


def sides(bill: DataFrame, *keys: str) -> DataFrame:
    """category with its original and compressed bits side by side."""
    side = lambda flag: F.coalesce(F.sum(F.when(F.col("is_compressed") == flag, F.col("bits"))), F.lit(0))
    return bill.groupBy(*keys, "category").agg(side(False).alias("original"), side(True).alias("compressed"))


def sign_balanced(bill: DataFrame) -> DataFrame:
    """(category, original, compressed) with signs at the cost of unpredicted signs, the difference taken from the first exponent.

    The interior's sign bits take the compressed side's count; edge and DC signs
    are scaled by the same ratio, dropping fractions.
    """
    of = lambda name, side: F.coalesce(F.sum(F.when(F.col("category") == name, F.col(side))), F.lit(0))
    parts = bill.agg(*(of(f"SIGN_{k}", s).alias(f"{s}_{k}") for k in ("7x7", "EDGE", "DC") for s in ("original", "compressed")))
    ratio = F.col("compressed_7x7") / F.col("original_7x7")
    move = parts.select((F.col("compressed_7x7") - F.col("original_7x7")).alias("m_7x7"), *((F.floor(ratio * F.col(f"original_{k}")) - F.col(f"original_{k}")).cast("long").alias(f"m_{k}") for k in ("EDGE", "DC")))
    out = bill.join(F.broadcast(move))  # one row
    change = F.lit(0).cast("long")
    for k in ("7x7", "EDGE", "DC"):
        change = F.when(F.col("category") == f"SIGN_{k}", F.col(f"m_{k}")).when(F.col("category") == f"EXP1_{k}", -F.col(f"m_{k}")).otherwise(change)
    return out.select("category", (F.col("original") + F.coalesce(change, F.lit(0))).alias("original"), "compressed")


def report(bill: DataFrame) -> DataFrame:
    """Items, subtotals by group and the total, with compressed over original in percent."""
    rows = bill.withColumn("part", group_of(F.col("category"))).rollup("part", "category").agg(F.sum("original").alias("original"), F.sum("compressed").alias("compressed"), F.grouping_id().cast("int").alias("level"))
    return rows.withColumn("ratio", bits.percent(F.col("compressed"), F.col("original")))


def observed(f: int, t: int, bit: int, saturating: bool = True) -> tuple[int, int, int]:
    """The counts and probability of false after one more bit.

    A count at 255 either stays, where the other bit was never seen (probability
    0 or 255), or both halve, rounding up, and the seen one becomes 129. The
    probability is 256 * f / (f + t), fraction dropped. Without saturation the
    counts always halve and the probability is made odd.
    """
    seen, other = (t, f) if bit else (f, t)
    if saturating and seen == 255 and other == 1:
        return f, t, 0 if bit else 255
    seen, other = (129, (other + 1) // 2) if seen == 255 else (seen + 1, other)
    f, t = (other, seen) if bit else (seen, other)
    p = 256 * f // (f + t)
    return f, t, p if saturating else p | 1


def adapted(df: DataFrame, key: str, order: list[str], bit_col: str, saturating: bool = True) -> DataFrame:
    """(key, n, f, t, p): each key's state after its bits in order, from one of each.

    A key's rows are in one partition, sorted; they pass through the state one by
    one, so a key of any number of rows takes no more memory than another.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int32()) for c in columns[1:])], [key, "n", "f", "t", "p"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, bit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != at:
                    if state is not None:
                        out.append((at, *state))
                    at, state = k, (0, 1, 1, 128)
                state = (state[0] + 1, *observed(state[1], state[2], bit, saturating))
            yield told()
            out = []
        if state is not None:
            out.append((at, *state))
            yield told()

    kind = df.schema[key].dataType.simpleString()
    rows = df.repartition(key).sortWithinPartitions(key, *order).select(key, bit_col)
    return rows.mapInArrow(kernel, f"`{key}` {kind}, n int, f int, t int, p int")


def implied(false: Column, true: Column) -> Column:
    return bits.int_div((false + 1) * 256, false + true + 2)


def printable(false: Column, true: Column, least: int, tolerance: float) -> Column:
    """What a slot's counts say: 'insignificant', 'close to half', or 'ok'."""
    share = true / (true + false)
    return F.when(true + false < least, "insignificant").when(F.abs(share - 0.5) < tolerance, "close to half").otherwise("ok")
