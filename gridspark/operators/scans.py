"""Operators along an order: deltas, runs, as-of look-ups, range assignment, splits, canonical codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from .ranking import ordered


def deltas(df: DataFrame, keys: list[str], order: list[str], value: str, restart: int | None = None) -> DataFrame:
    """df with restart_id, marker and delta: value less the one before it, from 0 at each restart interval.

    ``order`` must end in the column rn, the row's number within its key from 0.
    """
    rows = df.withColumn("restart_id", bits.int_div(F.col("rn"), restart) if restart else F.lit(0))
    rows = rows.withColumn("marker", (208 + F.col("restart_id").bitwiseAND(F.lit(7))).cast("int"))
    w = Window.partitionBy(*keys, "restart_id").orderBy(*order)
    return rows.withColumn("delta", F.col(value) - F.lag(value, 1).over(w)).withColumn("delta", F.coalesce("delta", F.col(value)))


def undeltas(df: DataFrame, keys: list[str], order: list[str], delta: str = "delta") -> DataFrame:
    """df with restored, the running sum of delta since the last restart."""
    w = Window.partitionBy(*keys, "restart_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("restored", F.sum(delta).over(w))


def islands(df: DataFrame, keys: list[str], order: list[str], member: Column) -> DataFrame:
    """(keys, island, first, length): maximal runs of rows for which member holds, numbered from 1 within a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_m", F.coalesce(member, F.lit(False))).withColumn("_rn", F.row_number().over(w))
    rows = rows.withColumn("_start", F.when(F.col("_m") & ~F.coalesce(F.lag("_m").over(w), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_m")
    return rows.groupBy(*keys, "island").agg(F.min("_rn").alias("first"), F.count("*").alias("length"))


def as_of(probes: DataFrame, marks: DataFrame, keys: list[str], at: str, payload: list[str], strict: bool = True) -> DataFrame:
    """Each probe with the payload of the last mark before it (strict) or not after it, within its key; null without one.

    The two sides are laid into one order and the last mark is carried forward,
    so the cost is one shuffle and one sort, whatever the matches. Marks with
    equal keys and places are ordered by payload.
    """
    side = F.lit(0 if strict else 1)
    mark = F.struct(*payload)
    both = probes.select("*", F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType).alias("_mark"), side.alias("_side"))
    other = marks.select(*keys, at, mark.alias("_mark"), F.lit(1 if strict else 0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(at, "_side", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.unionByName(other, allowMissingColumns=True).withColumn("_last", F.last("_mark", ignorenulls=True).over(w))
    probe_side = 0 if strict else 1
    return joined.where((F.col("_side") == probe_side) & F.col("_mark").isNull()).select(*probes.columns, *(F.col(f"_last.{c}").alias(f"found_{c}") for c in payload))


def last_before(probes: DataFrame, marks: DataFrame, at: str, payload: list[str], strict: bool = True) -> DataFrame:
    """as_of without keys: the order is cut into ranges, and each range starts from the last mark of those before it."""
    kind = marks.select(F.struct(*payload).alias("m")).schema["m"].dataType
    own = probes.select("*", F.lit(None).cast(kind).alias("_mark"), F.lit(0 if strict else 1).alias("_side"), F.lit(True).alias("_probe"))
    other = marks.select(at, F.struct(*payload).alias("_mark"), F.lit(1 if strict else 0).alias("_side"), F.lit(False).alias("_probe"))
    rows = ordered(own.unionByName(other, allowMissingColumns=True), [at, "_side", "_mark"])
    lasts = rows.where("not _probe").groupBy("range").agg(F.max_by("_mark", "place").alias("_m"))  # a row per partition
    ranges = rows.select("range").distinct().join(lasts, "range", "left")
    carried = ranges.select("range", F.last("_m", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    w = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_own", F.last("_mark", ignorenulls=True).over(w)).where("_probe").join(F.broadcast(carried), "range")
    last = F.coalesce("_own", "_before")
    return found.withColumn("_last", last).select(*probes.columns, *(F.col(f"_last.{c}").alias(f"found_{c}") for c in payload))


def in_ranges(df: DataFrame, ranges: DataFrame, value: str, limit: int = 64) -> DataFrame:
    """df joined to the range [start, end) that holds value; ranges don't overlap and the last one is open-ended.

    Up to ``limit`` ranges are broadcast and compared. More are found by
    ``last_before`` on their starts, whatever their widths; values before all
    ranges or in a gap are left out either way, as are nulls.
    """
    columns = [c for c in ranges.columns if c != "start"]
    top = ranges.agg(F.max("start").alias("top"))
    if ranges.limit(limit + 1).count() <= limit:
        some = F.broadcast(ranges.join(F.broadcast(top)))
        return df.join(some, (F.col(value) >= F.col("start")) & ((F.col(value) < F.col("end")) | (F.col("start") == F.col("top")))).drop("top")
    marks = ranges.join(F.broadcast(top)).select(F.col("start").alias("_value"), F.col("start"), *columns, (F.col("start") == F.col("top")).alias("open"))
    found = last_before(df.where(F.col(value).isNotNull()).withColumn("_value", F.col(value)), marks, "_value", ["start", *columns, "open"], strict=False)
    inside = found.where(F.col("found_open") | (F.col(value) < F.col("found_end")))
    return inside.select(*df.columns, *(F.col(f"found_{c}").alias(c) for c in ranges.columns))


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """(symbol, len) -> with code: canonical prefix codes, shorter first, equal lengths by symbol.

    A code is the sum of the shares of all earlier ones, at its own length; the
    symbols of a code table are at most some thousands of rows.
    """
    top = 62
    w = Window.orderBy("len", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum(F.expr(f"shiftleft(1L, {top} - len)")).over(w), F.lit(0).cast("long"))
    return lengths.withColumn("_s", share).withColumn("code", F.expr(f"shiftright(_s, {top} - len)")).drop("_s")


def ranked_lengths(counts: DataFrame) -> DataFrame:
    """(symbol, cnt) -> with len: code lengths by falling count, 2 * floor(log2(rank)) + 1, which fill no more than a prefix code can."""
    rank = F.row_number().over(Window.orderBy(F.desc("cnt"), "symbol"))
    return counts.withColumn("_r", rank).withColumn("len", (2 * bits.floor_log2(F.col("_r")) + 1).cast("int")).drop("_r")


def balanced_splits(df: DataFrame, key: str, order: list[str], size: str, most: int = 8) -> DataFrame:
    """(key, split_id, first_row, last_row, size): each key's rows, in order by a rising size, in near equal shares of the size.

    One split under 125,000 bytes, two under 250,000, four under 500,000, else
    ``most``, and no more than half the rows. A cut is the last row that is
    smaller than its share of the size; where two cuts coincide, rows are dealt
    evenly instead. Rows smaller than a share are counted by partial aggregates, so
    no key's rows meet but in the order's window.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.select(key, (F.row_number().over(w) - 1).alias("rn"), F.col(size).alias("size"))
    plan = rows.groupBy(key).agg(F.count("*").alias("n"), F.min_by("size", "rn").alias("base"), F.max_by("size", "rn").alias("top")).withColumn("total", F.col("top") - F.col("base"))
    by_rows = F.greatest(F.lit(1), F.least(F.lit(most), bits.int_div(F.col("n"), 2)))
    tier = F.when(F.col("total") < 125_000, 1).when(F.col("total") < 250_000, 2).when(F.col("total") < 500_000, 4).otherwise(most)
    plan = plan.withColumn("count", F.least(by_rows, tier))
    goal = lambda i: F.col("base") + bits.int_div(F.col("total") * i, F.col("count"))
    below = [F.sum(((F.col("rn") > 0) & (F.col("size") < goal(i)) & (F.col("count") > i)).cast("int")).alias(f"b{i}") for i in range(1, most)]
    told = rows.join(plan, key).groupBy(key, "n", "base", "count").agg(*below)
    inner = lambda a: F.slice(a, 1, (F.col("count") - 1).cast("int"))
    fair = inner(F.array(*(F.greatest(F.col(f"b{i}"), F.lit(1)) for i in range(1, most))))
    even = inner(F.array(*(bits.int_div(F.col("n") * i, F.col("count")) for i in range(1, most))))
    cuts = F.concat(F.when(F.size(F.array_distinct(fair)) < F.size(fair), even).otherwise(fair), F.array(F.col("n") - 1))
    splits = told.select(key, "base", F.posexplode(F.transform(cuts, lambda x: x.cast("int"))).alias("split_id", "last_row"))
    ends = splits.join(rows.select(key, F.col("rn").alias("last_row"), F.col("size").alias("end")), [key, "last_row"])
    before = Window.partitionBy(key).orderBy("split_id")
    first = F.coalesce(F.lag("last_row").over(before), F.lit(0))
    return ends.select(key, "split_id", first.alias("first_row"), "last_row", (F.col("end") - F.coalesce(F.lag("end").over(before), F.col("base"))).alias("size"))
