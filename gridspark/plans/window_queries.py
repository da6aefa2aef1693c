"""Queries along an order: deltas, runs, ranks, look-ups, splits, code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.layouts import ZIGZAG_TO_ALIGNED
from ..operators import scans as S
from ..operators.ranking import ranked
from ..sources.views import blocks, events, lines, table
from .block_queries import Z2A, run_symbols
from .registry import BLK, query

# The symbols of sixteen zeros and of a block's end.
LONG_RUN, END = 0xF0, 0x00

LINES = """l AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS rn, CAST(l_quantity AS BIGINT) AS qty FROM lineitem)"""
DELTAS = f"""{LINES},
r AS (SELECT *, rn // 4 AS restart_id FROM l),
d AS (SELECT *, qty - lag(qty, 1, 0) OVER (PARTITION BY l_orderkey, restart_id ORDER BY rn) AS delta FROM r)"""


@query(f"WITH {DELTAS} SELECT l_orderkey, CAST(rn AS INT) AS rn, restart_id, CAST(208 + (restart_id & 7) AS INT) AS marker, delta FROM d")
def dc_delta_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of an order's lines, each less the one before, afresh every four lines."""
    return S.deltas(lines(spark, sf_dir), ["l_orderkey"], ["rn"], "qty", restart=4).select("l_orderkey", "rn", "restart_id", "marker", "delta")


@query(f"WITH {DELTAS} SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(qty * (rn + 1)) AS BIGINT) AS checksum, TRUE AS equal FROM d GROUP BY l_orderkey")
def dc_undelta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of the deltas, which give the quantities back."""
    back = S.undeltas(S.deltas(lines(spark, sf_dir), ["l_orderkey"], ["rn"], "qty", restart=4), ["l_orderkey"], ["rn"])
    return back.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("restored") * (F.col("rn") + 1)).alias("checksum"), F.min(F.col("restored") == F.col("qty")).alias("equal"))


@query("""WITH e AS (SELECT user_id, event_type = 'view' AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT user_id, rn, rn - row_number() OVER (PARTITION BY user_id ORDER BY rn) AS g FROM e WHERE m),
i AS (SELECT user_id, min(rn) AS first, count(*) AS length FROM g GROUP BY user_id, g)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS island, CAST(first AS INT) AS first, length,
  CAST(length(bin(length)) - 1 AS INT) AS category, length - (1 << (length(bin(length)) - 1)) AS extra FROM i""")
def eob_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive views of a user, as run-length category and extra bits."""
    runs = S.islands(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view")
    category = bits.floor_log2(F.col("length"))
    return runs.select("user_id", "island", "first", "length", category.alias("category"), F.expr("length - shiftleft(1L, length(bin(length)) - 1)").alias("extra"))


CODES = """ranked AS (SELECT symbol, cnt, CAST(2 * (length(bin(row_number() OVER (ORDER BY cnt DESC, symbol))) - 1) + 1 AS INT) AS len FROM counts),
codes AS (
  SELECT symbol, cnt, len, CAST(coalesce(sum(1::BIGINT << (62 - len)) OVER (ORDER BY len, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> (62 - len) AS code FROM ranked)"""


@query(f"WITH counts AS (SELECT p_size AS symbol, count(*) AS cnt FROM part GROUP BY p_size), {CODES} SELECT symbol, cnt, len, CAST(code AS BIGINT) AS code FROM codes")
def huffman_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical prefix codes of part sizes, shorter for commoner sizes."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("symbol")).agg(F.count("*").alias("cnt"))
    return S.canonical_codes(S.ranked_lengths(counts))


@query(f"""WITH {BLK},
z AS (SELECT vec_id, unnest(list_transform({Z2A}, lambda i: coef[i])) AS v, CAST(unnest(range(64)) AS INT) AS pos FROM blk),
r AS (SELECT v, pos - lag(pos, 1, 0) OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS run FROM (SELECT * FROM z WHERE v <> 0 AND pos > 0)),
counts AS (SELECT CAST((run % 16) * 16 + length(bin(abs(v))) AS INT) AS symbol, count(*) AS cnt, sum(run // 16) AS long_runs FROM r GROUP BY 1), {CODES}
SELECT symbol, cnt, len, CAST(code AS BIGINT) AS code, CAST(cnt * (len + symbol % 16) AS BIGINT) AS total_bits FROM codes""")
def symbol_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that run and size symbols and their value bits take under canonical codes."""
    counts = run_symbols(spark, sf_dir).groupBy((F.col("run") * 16 + F.col("size")).alias("symbol")).agg(F.count("*").alias("cnt"))
    return S.canonical_codes(S.ranked_lengths(counts)).withColumn("total_bits", F.col("cnt") * (F.col("len") + F.col("symbol") % 16))


@query(f"""WITH {BLK},
z AS (SELECT vec_id, unnest(list_transform({Z2A}, lambda i: coef[i])) AS v, CAST(unnest(range(64)) AS INT) AS pos FROM blk),
r AS (SELECT vec_id, pos, v, pos - lag(pos, 1, 0) OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS run FROM z WHERE v <> 0 AND pos > 0),
s AS (SELECT *, length(bin(abs(v))) AS size, CAST((run % 16) * 16 + length(bin(abs(v))) AS INT) AS symbol FROM r),
ended AS (SELECT vec_id FROM z WHERE pos = 63 AND v = 0),
counts AS (SELECT symbol, count(*) AS cnt FROM s GROUP BY symbol UNION ALL SELECT 240, CAST(sum(run // 16) AS BIGINT) FROM s HAVING sum(run // 16) > 0 UNION ALL SELECT 0, count(*) FROM ended HAVING count(*) > 0), {CODES},
b AS (SELECT symbol, lpad(bin(code), len, '0') AS bits FROM codes),
c AS (
  SELECT vec_id, string_agg(repeat(coalesce((SELECT bits FROM b WHERE symbol = 240), ''), CAST(run // 16 AS BIGINT)) || bits || lpad(bin(CASE WHEN v > 0 THEN v ELSE v - 1 + (1 << size) END), CAST(size AS INT), '0'), '' ORDER BY pos) AS bits
  FROM s JOIN b USING (symbol) GROUP BY vec_id),
w AS (SELECT blk.vec_id, coalesce(c.bits, '') || CASE WHEN e.vec_id IS NOT NULL THEN (SELECT bits FROM b WHERE symbol = 0) ELSE '' END AS bits FROM blk LEFT JOIN c ON c.vec_id = blk.vec_id LEFT JOIN ended e ON e.vec_id = blk.vec_id)
SELECT vec_id, CAST(length(bits) AS INT) AS n_bits, md5(bits) AS md5 FROM w""")
def scan_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coded bits of each block's scan: codes of its symbols, long runs and end, with the values' own bits between."""
    symbols = run_symbols(spark, sf_dir, value=True).withColumn("symbol", F.col("run") * 16 + F.col("size"))
    last = blocks(spark, sf_dir).select("vec_id", (F.get("coef", ZIGZAG_TO_ALIGNED[63]) == 0).alias("ended"))
    counts = symbols.groupBy("symbol").agg(F.count("*").alias("cnt")).union(symbols.select(F.lit(LONG_RUN), F.sum("long_runs"))).union(last.where("ended").select(F.lit(END), F.count("*"))).where("cnt > 0")
    # A code table has a row per symbol, 256 at most.
    codes = F.broadcast(S.canonical_codes(S.ranked_lengths(counts)).select("symbol", F.lpad(F.bin("code"), F.col("len"), F.lit("0")).alias("bits")))
    of = lambda symbol, name: F.broadcast(codes.agg(F.coalesce(F.max(F.when(F.col("symbol") == symbol, F.col("bits"))), F.lit("")).alias(name)))
    own = F.lpad(F.bin(bits.to_envelope(F.col("v").cast("long"), F.col("size"))), F.col("size"), F.lit("0"))
    told = symbols.join(codes, "symbol").join(of(LONG_RUN, "zeros")).select("vec_id", F.struct("pos", F.concat(F.repeat("zeros", F.col("long_runs")), "bits", own).alias("b")).alias("x"))
    scans = told.groupBy("vec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("bits"))
    whole = last.join(scans, "vec_id", "left").join(of(END, "end"))
    line = F.concat(F.coalesce("bits", F.lit("")), F.when(F.col("ended"), F.col("end")).otherwise(""))
    return whole.select("vec_id", F.length(line).alias("n_bits"), F.md5(line).alias("md5"))


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), m AS (SELECT * FROM events WHERE event_type = 'click')
SELECT p.event_id, m.event_id AS found_event_id, CAST(epoch_us(p.ts) - epoch_us(m.ts) AS BIGINT) AS past_us
FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.ts > m.ts""")
def asof_offset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click strictly before it, and the remainder."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.withColumn("at", us)
    found = S.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "at"), e.where("event_type = 'click'").select("user_id", "at", F.col("at").alias("mark_at"), "event_id"), ["user_id"], "at", ["mark_at", "event_id"])
    return found.select("event_id", "found_event_id", (F.col("at") - F.col("found_mark_at")).alias("past_us"))


@query("""WITH b AS (SELECT max(p_partkey) AS top FROM part),
s AS (SELECT k AS split_id, top * k // 8 AS start, top * (k + 1) // 8 AS "end" FROM b, (SELECT CAST(unnest(range(8)) AS BIGINT) AS k) WHERE TRUE)
SELECT split_id, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, min(l_partkey) AS low, max(l_partkey) AS high
FROM lineitem JOIN s ON l_partkey >= start AND (l_partkey < "end" OR split_id = 7) GROUP BY split_id""")
def range_split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the split of the part keys that holds them."""
    top = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("top"))
    splits = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("split_id"), "top").select("split_id", bits.int_div(F.col("top") * F.col("split_id"), 8).alias("start"), bits.int_div(F.col("top") * (F.col("split_id") + 1), 8).alias("end"))
    found = S.in_ranges(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), splits, "l_partkey")
    return found.groupBy("split_id").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"))


@query("""WITH c AS (
  SELECT o_custkey, list(size ORDER BY o_orderkey) AS s FROM (
    SELECT o_custkey, o_orderkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS size FROM orders) GROUP BY o_custkey),
t AS (SELECT *, len(s) AS n, s[len(s)] - s[1] AS total FROM c),
k AS (SELECT *, least(greatest(1, least(8, n // 2)), CASE WHEN total < 125000 THEN 1 WHEN total < 250000 THEN 2 WHEN total < 500000 THEN 4 ELSE 8 END) AS k FROM t),
f AS (
  SELECT *, list_transform(range(1, k), lambda i: greatest(len(list_filter(s[2:], lambda x: x < s[1] + total * i // k)), 1)) AS fair, list_transform(range(1, k), lambda i: n * i // k) AS even FROM k),
cuts AS (SELECT o_custkey, s, list_concat(CASE WHEN len(list_distinct(fair)) < len(fair) THEN even ELSE fair END, [n - 1]) AS cuts FROM f)
SELECT o_custkey, CAST(i - 1 AS INT) AS split_id, CAST(CASE WHEN i = 1 THEN 0 ELSE cuts[i - 1] END AS INT) AS first_row, CAST(cuts[i] AS INT) AS last_row,
  CAST(s[cuts[i] + 1] - s[CASE WHEN i = 1 THEN 0 ELSE cuts[i - 1] END + 1] AS BIGINT) AS size
FROM (SELECT *, unnest(range(1, len(cuts) + 1)) AS i FROM cuts)""")
def balanced_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as rows of an image: where it splits into near equal segments, and their sizes."""
    return split_rows(spark, sf_dir)


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    sized = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum(F.floor("o_totalprice").cast("long")).over(w).alias("size"))
    return S.balanced_splits(sized, "o_custkey", ["o_orderkey"], "size")


@query("SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS rank, CAST(row_number() OVER (ORDER BY value, event_id) AS DOUBLE) / count(*) OVER () AS proportion FROM events")
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empirical distribution of event values; ties get rising ranks."""
    return ranked(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id").select("event_id", "value", "rank", (F.col("rank") / F.col("total")).alias("proportion"))


@query("""WITH e AS (
  SELECT user_id, event_id, sum(CAST(floor(abs(value) * 8) AS BIGINT)) OVER w AS done, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS elapsed
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, CAST(done * 1000000000 // elapsed AS BIGINT) AS rate FROM e WHERE elapsed > 0)
SELECT user_id, max(rate) AS peak, CAST(max_by(event_id, struct_pack(rate := rate, e := event_id)) AS BIGINT) AS at_event, CAST(max(done) AS BIGINT) AS total, CAST(max(elapsed) AS BIGINT) AS elapsed FROM r GROUP BY user_id""")
def throughput_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's highest rate of work since the first event, and the event that reached it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events(spark, sf_dir).select("user_id", "event_id", F.sum("units").over(w).alias("done"), (us - F.min(us).over(Window.partitionBy("user_id"))).alias("elapsed"))
    rows = rows.where("elapsed > 0").withColumn("rate", bits.int_div(F.col("done") * 1_000_000_000, F.col("elapsed")))
    return rows.groupBy("user_id").agg(F.max("rate").alias("peak"), F.max_by("event_id", F.struct("rate", "event_id")).alias("at_event"), F.max("done").alias("total"), F.max("elapsed").alias("elapsed"))


@query("""WITH e AS (SELECT user_id, event_id, CAST(epoch_us(ts) AS BIGINT) AS us, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS first FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*) AS n, CAST(min(us) - min(first) AS BIGINT) AS earliest, CAST(max(us - first) AS BIGINT) AS latest, CAST(sum(us - first) AS BIGINT) AS total FROM e GROUP BY user_id""")
def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage stamps of a user less the earliest one."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").where("value is not null").withColumn("since", us - F.min(us).over(Window.partitionBy("user_id")))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min("since").alias("earliest"), F.max("since").alias("latest"), F.sum("since").alias("total"))


@query("""WITH r AS (
  SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS start, CAST(l_quantity AS BIGINT) + l_linenumber AS stop,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem),
f AS (SELECT *, greatest(start, coalesce(lag(stop) OVER (PARTITION BY l_orderkey ORDER BY rn), start)) AS fixed, lead(start) OVER (PARTITION BY l_orderkey ORDER BY rn) - start AS gap FROM r)
SELECT l_orderkey, CAST(sum(fixed) AS BIGINT) AS fixed, CAST(coalesce(sum(gap), 0) AS BIGINT) AS gaps FROM f GROUP BY l_orderkey""")
def boundary_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts raised to the end before them, and the gaps between consecutive starts."""
    w = Window.partitionBy("l_orderkey").orderBy("rn")
    rows = lines(spark, sf_dir).withColumn("stop", F.col("qty") + F.col("l_linenumber"))
    rows = rows.select("l_orderkey", F.greatest("qty", F.coalesce(F.lag("stop").over(w), "qty")).alias("fixed"), (F.lead("qty").over(w) - F.col("qty")).alias("gap"))
    return rows.groupBy("l_orderkey").agg(F.sum("fixed").alias("fixed"), F.coalesce(F.sum("gap"), F.lit(0).cast("long")).alias("gaps"))
