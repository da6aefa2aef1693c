"""Structured Streaming jobs over arriving event files, run until the files present are read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ledger as L
from ..sources.shared import shared_base


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Events as files arrive; files_per_batch bounds the work of one batch."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("bit", (F.col("event_type") == "click").cast("int")).withColumn("units", F.floor(F.abs("value") * 8).cast("long"))


def drained(stream: DataFrame, mode: str, add) -> None:
    """Run a stream over what is there now; add(frame, batch) takes each batch's rows."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).foreachBatch(add).start()
    query.awaitTermination()


def latest(spark: SparkSession, folder: str, schema: str, keys: list[str], order: str) -> DataFrame:
    """The last row of each key among all batches written to folder."""
    rows = spark.read.schema(schema).parquet(f"{folder}/*")
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("x")).select(*keys, "x.*")


def billed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    rows = event_stream(spark, sf_dir).select(F.col("event_type").alias("category"), (F.col("event_id") % 2 == 0).alias("is_compressed"), F.col("units").alias("bits"))

    def add(frame: DataFrame, batch: int) -> None:
        frame.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/{batch}")

    drained(L.billed(rows), "update", add)
    return latest(spark, folder, "category string, is_compressed boolean, bits long, batch int", ["category", "is_compressed"], "batch").drop("batch")


def _adapt(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, f, t, p = state.get if state.exists else (0, 1, 1, 128)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for bit in rows["bit"].tolist():
        f, t, p = L.observed(f, t, bit)
    n += len(rows)
    state.update((n, f, t, p))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "f": [f], "t": [t], "p": [p]})


def branch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events within a batch are taken in order of time; later batches go on from the state."""
    folder = shared_folder(spark)
    schema = "user_id long, n int, f int, t int, p int"
    rows = event_stream(spark, sf_dir).select("user_id", "ts", "event_id", "bit")
    states = rows.groupBy("user_id").applyInPandasWithState(_adapt, schema, "n int, f int, t int, p int", "update", GroupStateTimeout.NoTimeout)

    def add(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{folder}/{batch}")

    drained(states, "update", add)
    return latest(spark, folder, schema, ["user_id"], "n")


def answered_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 8) -> DataFrame:
    """Digest and size of each arriving document; at most files_per_batch files are in work at a time."""
    folder = shared_folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/document[s].parquet")
    answers = arriving.select("doc_id", F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("n_bytes"))

    def add(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{folder}/{batch}")

    drained(answers, "append", add)
    return spark.read.schema("doc_id long, md5 string, n_bytes long").parquet(f"{folder}/*")
