"""A registry of queries: name, Spark function, SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: DuckDB's view of the blocks.
BLK = """blk AS (
  SELECT vec_id, vec_id // 256 AS image_id, CAST((vec_id % 256) // 16 AS INT) AS by, CAST(vec_id % 16 AS INT) AS bx,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 32) AS INT)) AS coef
  FROM embeddings)"""

#: Bits that hold a magnitude, as a DuckDB expression.
BITLEN = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin(abs({0}))) END"


def sql_list(values: list[int]) -> str:
    return "[" + ", ".join(map(str, values)) + "]"
