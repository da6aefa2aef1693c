"""Global order without a global sort task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def ordered(df: DataFrame, order: list) -> DataFrame:
    """df in ranges of a global order, one a partition, with range (its number) and place (from 0 within it).

    Spark cuts the ranges by a sample of all order columns together, so equal
    values, nulls and NaNs are spread by the columns after them. One shuffle; the
    result is written once, as later steps read it more than once.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at)
    # The id holds the partition's number above 33 bits of a row's place in it.
    return checkpointed(rows.select(*df.columns, F.shiftright("_at", 33).cast("int").alias("range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))


def ranked(df: DataFrame, value: str, tie: str) -> DataFrame:
    """df with rank (1 .. n by value, then tie) and total (n); nulls come first, NaNs last."""
    rows = ordered(df, [F.col(value).asc_nulls_first(), F.col(tie).asc_nulls_first()])
    sizes = rows.groupBy("range").agg((F.max("place") + 1).alias("n"))  # a row per partition
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return rows.join(F.broadcast(before), "range").withColumn("rank", F.col("place") + F.col("before") + 1).drop("range", "place", "before")
