"""The folder that driver and executors share, and what is written there to cut lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the one set as checkpoint folder.

    Where neither is set, a temporary folder is taken if driver and executors are
    one process; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gridspark-")
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared folder, cutting its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return df.checkpoint()
