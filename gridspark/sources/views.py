"""Tables and the block, byte and event views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, image_id, by, bx, coef array<int>): each vector as a block of 64 coefficients in aligned order."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.expr("vec_id div 256").alias("image_id"),
        F.expr("cast((vec_id % 256) div 16 as int)").alias("by"),
        F.expr("cast(vec_id % 16 as int)").alias("bx"),
        F.expr("transform(embedding, x -> cast(floor(cast(x as double) * 32) as int))").alias("coef"),
    )


def coefficients(blk: DataFrame) -> DataFrame:
    """One row per coefficient: (vec_id, image_id, by, bx, pos, v)."""
    return blk.select("vec_id", "image_id", "by", "bx", F.posexplode("coef").alias("pos", "v"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with bit (1 for a click) and units (whole units of the value's size)."""
    return table(spark, sf_dir, "events").withColumn("bit", (F.col("event_type") == "click").cast("int")).withColumn("units", F.floor(F.abs("value") * 8).cast("long"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with rn, their place in the order by the full sort key."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w) - 1).withColumn("qty", F.col("l_quantity").cast("long"))
