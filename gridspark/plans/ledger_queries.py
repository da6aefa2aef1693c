"""Queries on bit ledgers and adaptive probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..sources.views import events
from ..streaming import jobs
from .registry import query

SIMPLE = "SELECT event_type AS category, event_id % 2 = 0 AS is_compressed, CAST(sum(CAST(floor(abs(value) * 8) AS BIGINT)) AS BIGINT) AS bits FROM events GROUP BY ALL"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger entries; the category is one of the 26 by event number."""
    return events(spark, sf_dir).select(L.category(F.col("event_id")).alias("category"), (F.expr("event_id div 26") % 2 == 0).alias("is_compressed"), F.col("units").alias("bits"))


@query(SIMPLE)
def bill_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits by event type and side."""
    rows = events(spark, sf_dir).select(F.col("event_type").alias("category"), (F.col("event_id") % 2 == 0).alias("is_compressed"), F.col("units").alias("bits"))
    return L.billed(rows)


NAMES_SQL = "[" + ", ".join(f"'{c}'" for c in L.NAMES) + "]"
BILL = f"""e AS (SELECT ({NAMES_SQL})[event_id % 26 + 1] AS category, (event_id // 26) % 2 = 0 AS is_compressed, CAST(floor(abs(value) * 8) AS BIGINT) AS bits FROM events),
b AS (SELECT category, CAST(coalesce(sum(bits) FILTER (NOT is_compressed), 0) AS BIGINT) AS original, CAST(coalesce(sum(bits) FILTER (is_compressed), 0) AS BIGINT) AS compressed FROM e GROUP BY category)"""
GROUP_SQL = "CASE " + " ".join(f"WHEN category IN ({', '.join(repr(c) for c in names)}) THEN '{g}'" for g, names in L.CATEGORIES.items()) + " END"


@query(f"""WITH {BILL},
r AS (SELECT part, category, CAST(sum(original) AS BIGINT) AS original, CAST(sum(compressed) AS BIGINT) AS compressed, CAST(grouping(part, category) AS INT) AS level FROM (SELECT *, {GROUP_SQL} AS part FROM b) GROUP BY ROLLUP (part, category))
SELECT *, CASE WHEN original <> 0 THEN floor(compressed * 10000 / original) / 100.0 END AS ratio FROM r""")
def bill_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bill by item, group and in total."""
    return L.report(L.sides(L.billed(entries(spark, sf_dir))))


@query(f"""WITH {BILL},
s AS (SELECT sum(original) FILTER (category = 'SIGN_7x7') AS o, sum(compressed) FILTER (category = 'SIGN_7x7') AS c, sum(original) FILTER (category = 'SIGN_EDGE') AS e, sum(original) FILTER (category = 'SIGN_DC') AS d FROM b),
m AS (SELECT c - o AS m7, CAST(floor(CAST(c AS DOUBLE) / o * e) AS BIGINT) - e AS me, CAST(floor(CAST(c AS DOUBLE) / o * d) AS BIGINT) - d AS md FROM s)
SELECT category, CAST(original + CASE category WHEN 'SIGN_7x7' THEN m7 WHEN 'EXP1_7x7' THEN -m7 WHEN 'SIGN_EDGE' THEN me WHEN 'EXP1_EDGE' THEN -me WHEN 'SIGN_DC' THEN md WHEN 'EXP1_DC' THEN -md ELSE 0 END AS BIGINT) AS original, compressed FROM b, m WHERE TRUE""")
def bill_fixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bill with sign costs redistributed."""
    return L.sign_balanced(L.sides(L.billed(entries(spark, sf_dir))))


def _recursive(saturating: bool) -> str:
    stay = "(CASE WHEN bit = 1 THEN f ELSE t END) = 1" if saturating else "FALSE"
    p = "CASE WHEN stay THEN CASE WHEN b = 1 THEN 0 ELSE 255 END ELSE 256 * nf // (nf + nt) END" if saturating else "(256 * nf // (nf + nt)) | 1"
    return f"""WITH RECURSIVE e AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS bit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s(user_id, rn, f, t, p) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), 1, 1, 128 FROM e
  UNION ALL
  SELECT user_id, rn, nf, nt, CAST({p} AS INT) FROM (
    SELECT user_id, rn, b, stay,
      CAST(CASE WHEN b = 0 THEN ns ELSE no END AS INT) AS nf, CAST(CASE WHEN b = 0 THEN no ELSE ns END AS INT) AS nt FROM (
      SELECT user_id, rn, bit AS b, "full" AND {stay} AS stay,
        CASE WHEN "full" AND {stay} THEN 255 WHEN "full" THEN 129 ELSE (CASE WHEN bit = 1 THEN t ELSE f END) + 1 END AS ns,
        CASE WHEN "full" AND NOT ({stay}) THEN ((CASE WHEN bit = 1 THEN f ELSE t END) + 1) // 2 ELSE (CASE WHEN bit = 1 THEN f ELSE t END) END AS no
      FROM (SELECT e.user_id, e.rn, e.bit, s.f, s.t, (CASE WHEN e.bit = 1 THEN s.t ELSE s.f END) = 255 AS "full" FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1))))
SELECT user_id, CAST(rn AS INT) AS n, f, t, p FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1"""


def _states(spark: SparkSession, sf_dir: str, saturating: bool) -> DataFrame:
    return L.adapted(events(spark, sf_dir).select("user_id", "ts", "event_id", "bit"), "user_id", ["ts", "event_id"], "bit", saturating)


@query(_recursive(True))
def adaptive_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's adaptive probability after all clicks and other events, in order."""
    return _states(spark, sf_dir, True)


@query(_recursive(False))
def adaptive_branch_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant without saturation."""
    return _states(spark, sf_dir, False)


TOTALS = "SELECT event_type, user_id % 64 AS slot, count(*) FILTER (event_id % 3 <> 0) AS f, count(*) FILTER (event_id % 3 = 0) AS t FROM events GROUP BY ALL"


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.sum(c.cast("long"))
    return events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 64).alias("slot")).agg(count(F.col("event_id") % 3 != 0).alias("f"), count(F.col("event_id") % 3 == 0).alias("t"))


@query(f"SELECT *, CAST(256 * (f + 1) // (f + t + 2) AS BIGINT) AS p FROM ({TOTALS})")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of false and true by slot, and the probability that they imply."""
    return totals(spark, sf_dir).withColumn("p", L.implied(F.col("f"), F.col("t")))


@query(f"SELECT *, CASE WHEN f + t < 10 THEN 'insignificant' WHEN abs(CAST(t AS DOUBLE) / (f + t) - 0.5) < 0.1 THEN 'close to half' ELSE 'ok' END AS kind FROM ({TOTALS}) WHERE f + t >= 2")
def model_printability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots worth printing, and why."""
    return totals(spark, sf_dir).where("f + t >= 2").withColumn("kind", L.printable(F.col("f"), F.col("t"), 10, 0.1))


@query(f"WITH x AS ({TOTALS}) SELECT event_type, CAST(sum(f + t) AS BIGINT) AS n, round(sum(-f * log2((256 * (f + 1) // (f + t + 2) + 0.5) / 256) - t * log2(1 - (256 * (f + 1) // (f + t + 2) + 0.5) / 256)), 6) AS ideal_bits FROM x GROUP BY event_type")
def ideal_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideal code length of all bits under the implied probabilities."""
    p = (L.implied(F.col("f"), F.col("t")) + 0.5) / 256
    return totals(spark, sf_dir).groupBy("event_type").agg(F.sum(F.col("f") + F.col("t")).alias("n"), F.round(F.sum(-F.col("f") * F.log2(p) - F.col("t") * F.log2(1 - p)), 6).alias("ideal_bits"))


@query("""WITH c AS (SELECT event_type, value, CASE WHEN abs(value) > 150 THEN 2 WHEN abs(value) > 75 THEN 1 ELSE 0 END AS level FROM events)
SELECT event_type, count(*) FILTER (level < 2) AS kept, count(*) FILTER (level = 1) AS warned, count(*) FILTER (level = 2) AS failed,
  CASE WHEN count(*) FILTER (level < 2) > 0 THEN CAST(sum(CASE WHEN level < 2 THEN CAST(floor(abs(value) * 8) AS BIGINT) END) AS BIGINT) * 10000 // sum(CASE WHEN level < 2 THEN CAST(floor(abs(value) * 16) AS BIGINT) + 1 END) / 100.0 END AS ratio
FROM c GROUP BY event_type""")
def error_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows carry an error level; fatal ones leave the sums, and the ratio is of what remains."""
    v = F.abs("value")
    rows = events(spark, sf_dir).withColumn("level", F.when(v > 150, 2).when(v > 75, 1).otherwise(0))
    ok, count = F.col("level") < 2, lambda c: F.sum(c.cast("long"))
    top, bottom = F.sum(F.when(ok, F.col("units"))), F.sum(F.when(ok, F.floor(v * 16) + 1))
    return rows.groupBy("event_type").agg(count(ok).alias("kept"), count(F.col("level") == 1).alias("warned"), count(F.col("level") == 2).alias("failed"), (F.floor(top * 10000 / bottom) / 100.0).alias("ratio"))


@query(SIMPLE)
def stream_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_by_category, kept up by a stream over the event files."""
    return jobs.billed_stream(spark, sf_dir)


@query(_recursive(True))
def stream_branch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adaptive_branch, kept up by a stream with a state per user."""
    return jobs.branch_stream(spark, sf_dir)


