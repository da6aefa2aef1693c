"""Queries on header segments, hand-off records and block tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import segments as G
from ..sources.views import blocks, table
from .registry import BITLEN, BLK, SQL, query
from .window_queries import split_rows

HEX2, HEX4 = "lpad(hex({0}), 2, '0')", "lpad(hex({0}), 4, '0')"
#: Each part as a header: marker, an application segment, tables in some, frame, restart interval in some, scan.
HEADERS = f"""p AS (
  SELECT p_partkey AS image_id, p_size * 53 AS h, p_partkey * 37 % 4000 + 1 AS w, (1 + p_size % 3) * 16 + 1 + p_partkey % 2 AS f, p_partkey % 5 AS k FROM part),
s AS (
  SELECT image_id, unnest([224, CASE WHEN k <> 0 THEN 219 END, CASE WHEN k <> 4 THEN 192 END, CASE WHEN k % 2 = 1 THEN 221 END, 196, 218]) AS kind, unnest(range(6)) AS n,
    unnest(['AABB', '00' || {HEX2.format("k + 1")} || '07', '08' || {HEX4.format("h")} || {HEX4.format("w")} || '0101' || {HEX2.format("f")} || '00', {HEX4.format("k + 4")}, '0001', '010100003F00']) AS payload FROM p),
g AS (SELECT *, length(payload) // 2 + 2 AS len, 2 + coalesce(sum(length(payload) // 2 + 4) OVER (PARTITION BY image_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s WHERE kind IS NOT NULL)"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, empty = F.col("p_partkey") % 5, F.unhex(F.lit(""))
    be = bits.big_endian
    frame = F.concat(G.byte(8), be(F.col("p_size") * 53), be(F.col("p_partkey") * 37 % 4000 + 1), F.unhex(F.lit("0101")), G.byte((1 + F.col("p_size") % 3) * 16 + 1 + F.col("p_partkey") % 2), G.byte(0))
    raw = F.concat(
        F.unhex(F.lit("FFD8")),
        G.segment(0xE0, F.unhex(F.lit("AABB"))),
        F.when(k != 0, G.segment(G.QUANT_TABLE, F.concat(G.byte(0), G.byte(k + 1), G.byte(7)))).otherwise(empty),
        F.when(k != 4, G.segment(G.FRAME, frame)).otherwise(empty),
        F.when(k % 2 == 1, G.segment(G.RESTART, be(k + 4))).otherwise(empty),
        G.segment(G.CODE_TABLE, F.unhex(F.lit("0001"))),
        G.segment(G.SCAN, F.unhex(F.lit("010100003F00"))),
        F.unhex(F.lit("12FF0034FFD9")),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), raw.alias("raw"))


@query(f"WITH {HEADERS} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n) - 1 AS INT) AS seq, CAST(kind AS INT) AS kind, CAST(start AS INT) AS \"offset\", CAST(len AS INT) AS len, payload FROM g")
def header_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each part's header."""
    found = headers(spark, sf_dir).select("image_id", F.posexplode(G.segments(F.col("raw"))).alias("seq", "s"))
    return found.select("image_id", "seq", "s.kind", "s.offset", "s.len", F.hex("s.payload").alias("payload"))


@query("""WITH p AS (SELECT p_partkey AS image_id, CAST(p_size * 53 AS BIGINT) AS h, CAST(p_partkey * 37 % 4000 + 1 AS BIGINT) AS w, CAST(1 + p_size % 3 AS BIGINT) AS sh, CAST(1 + p_partkey % 2 AS BIGINT) AS sv, p_partkey % 5 AS k FROM part)
SELECT image_id, CASE WHEN k <> 4 THEN h END AS height, CASE WHEN k <> 4 THEN w END AS width, CASE WHEN k <> 4 THEN 1::BIGINT END AS components, CASE WHEN k <> 4 THEN sh END AS sh, CASE WHEN k <> 4 THEN sv END AS sv,
  CASE WHEN k % 2 = 1 THEN k + 4 ELSE 0 END AS restart, CASE WHEN k = 4 THEN 'no frame' WHEN k = 0 THEN 'no table' WHEN sh > 2 THEN 'sampling' ELSE 'ok' END AS error FROM p""")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a header says, or why it is refused; a bad row carries its error and fails no job."""
    found = headers(spark, sf_dir).select("image_id", G.segments(F.col("raw")).alias("s"))
    return found.select("image_id", *(c.alias(k) for k, c in G.frame_fields(F.col("s")).items()))


@query(f"WITH {HEADERS} SELECT image_id, 'FFD8' || string_agg('FF' || {HEX2.format('kind')} || {HEX4.format('len')} || payload, '' ORDER BY n) AS header FROM g WHERE kind <> 224 GROUP BY image_id")
def header_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without the segments that decoding doesn't need."""
    return headers(spark, sf_dir).select("image_id", F.hex(G.rebuilt(G.segments(F.col("raw")))).alias("header"))


@query("""SELECT p_partkey AS image_id, upper(md5(CAST(p_partkey AS VARCHAR)) || md5(CAST(p_size AS VARCHAR)) || 'ff') AS scan, CAST(1 + p_partkey % 2 AS INT) AS restarts, upper(substr(md5(CAST(p_partkey AS VARCHAR)), 1, CAST(2 * (p_partkey % 4) AS BIGINT))) AS trailing FROM part""")
def scan_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole images: their scan's bytes without fillers and restart marks, the marks counted, and the garbage after their end."""
    k = F.col("p_partkey")
    digest = lambda c: F.unhex(F.md5(c.cast("string")))
    data = F.concat(bits.stuffed(digest(k), 0xFF), F.unhex(F.when(k % 2 == 0, "FFD3").otherwise("FFD0FFD7")), bits.stuffed(F.concat(digest(F.col("p_size")), F.unhex(F.lit("FF"))), 0xFF))
    raw = F.concat(F.unhex(F.lit("FFD8")), G.segment(0xE0, F.unhex(F.lit("FFD9AA"))), G.segment(G.SCAN, F.unhex(F.lit("010100003F00"))), data, F.unhex(F.lit("FFD9")), F.substring(digest(k), F.lit(1), (k % 4).cast("int")))
    rows = table(spark, sf_dir, "part").select(k.alias("image_id"), raw.alias("raw"))
    parts = rows.select("image_id", G.scan_parts(F.col("raw"), G.segments(F.col("raw"))).alias("s"))
    return parts.select("image_id", F.hex("s.scan").alias("scan"), "s.restarts", F.hex("s.trailing").alias("trailing"))


LE = "substr(lpad(hex({0}), 8, '0'), 7, 2) || substr(lpad(hex({0}), 8, '0'), 5, 2)"


@query(f"""WITH r AS ({{splits}})
SELECT o_custkey, '48' || {HEX2.format("count(*)")} || string_agg({LE.format("first_row")} || {LE.format("size")} || substr(lpad(hex(size), 8, '0'), 3, 2) || substr(lpad(hex(size), 8, '0'), 1, 2)
  || {HEX2.format("split_id * 16")} || {HEX2.format("split_id % 8")} || {LE.format("(65536 - last_row) % 65536")} || {LE.format("split_id")} || '00000000', '' ORDER BY split_id) AS record, TRUE AS equal
FROM r GROUP BY o_custkey""".replace("{splits}", SQL["balanced_splits"]))
def handoff_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's splits as hand-off records, and whether they read back."""
    splits = split_rows(spark, sf_dir)
    record = G.handoff(F.col("first_row"), F.col("size"), F.col("split_id") * 16, F.col("split_id") % 8, [-F.col("last_row"), F.col("split_id")])
    rows = splits.withColumn("r", record).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("split_id", "first_row", "last_row", "size", "r"))).alias("s"))
    rows = rows.withColumn("raw", G.handoff_list(F.transform("s", lambda x: x["r"])))
    back = G.read_handoffs(F.col("raw"))
    same = F.forall(F.zip_with("s", back, lambda a, b: (a["first_row"] == b["start"]) & (a["size"] == b["size"]) & (b["last"] == F.array((-a["last_row"]).cast("long"), a["split_id"].cast("long"), F.lit(0).cast("long")))), lambda ok: ok)
    return rows.select("o_custkey", F.hex("raw").alias("record"), same.alias("equal"))


def _region(name: str, first: int, n: int, width: int) -> str:
    return f"""SELECT v, '{name}' AS suffix FROM (SELECT unnest(c[1:coalesce(list_max(list_transform(range(1, {n} + 1), lambda i: CASE WHEN c[i] <> 0 THEN i ELSE 0 END)), 0)]) AS v FROM (SELECT coef[{first + 1}:{first + n}] AS c FROM blk))"""


def _counted(name: str, first: int, n: int, width: int) -> str:
    return f"""SELECT 'NZ_{name}' AS category, (k >> i) & 1 AS bit FROM (SELECT len(list_filter(coef[{first + 1}:{first + n}], lambda x: x <> 0)) AS k FROM blk), (SELECT unnest(range({width})) AS i) WHERE TRUE"""


_REGIONS = [("7x7", 0, 49, 6), ("EDGE", 50, 7, 3), ("EDGE", 57, 7, 3)]


@query(f"""WITH {BLK},
c AS ({" UNION ALL ".join(_region(*r) for r in _REGIONS)}),
l AS (SELECT v, suffix, {BITLEN.format("v")} AS size FROM c),
t AS (
  SELECT (['BITMAP', 'EXP1', 'EXP2', 'EXP3', 'EXPN'])[least(i, 4) + 1] || '_' || suffix AS category, CASE WHEN size <> i THEN 1 ELSE 0 END AS bit FROM (SELECT *, unnest(range(least(size, 10) + 1)) AS i FROM l)
  UNION ALL SELECT 'SIGN_' || suffix, CASE WHEN v >= 0 THEN 1 ELSE 0 END FROM l WHERE size > 0
  UNION ALL SELECT 'RES_' || suffix, (abs(v) >> i) & 1 FROM (SELECT *, unnest(range(size - 1)) AS i FROM l WHERE size > 1)
  UNION ALL {" UNION ALL ".join(_counted(*r) for r in _REGIONS)})
SELECT category, count(*) FILTER (bit = 0) AS zeros, count(*) FILTER (bit = 1) AS ones FROM t GROUP BY category""")
def block_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all blocks by category."""
    return G.tokens(blocks(spark, sf_dir))


def _tokens_sql(name: str, first: int, n: int, width: int) -> str:
    size = "CASE WHEN v = 0 THEN 0 ELSE length(bin(abs(v))) END"
    some = f"coef[{first + 1}:{first + n}]"
    last = f"coalesce(list_max(list_transform(range(1, {n} + 1), lambda i: CASE WHEN ({some})[i] <> 0 THEN i ELSE 0 END)), 0)"
    unary = f"list_transform(range(least({size}, 10) + 1), lambda i: (['BITMAP', 'EXP1', 'EXP2', 'EXP3', 'EXPN'])[least(i, 4) + 1] || '_{name}:' || CASE WHEN {size} <> i THEN '1' ELSE '0' END)"
    sign = f"CASE WHEN v <> 0 THEN ['SIGN_{name}:' || CASE WHEN v >= 0 THEN '1' ELSE '0' END] ELSE [] END"
    rest = f"list_transform(range(greatest({size} - 1, 0)), lambda i: 'RES_{name}:' || CAST((abs(v) >> i) & 1 AS VARCHAR))"
    counted = f"list_transform(range({width}), lambda i: 'NZ_{name}:' || CAST((CAST(len(list_filter({some}, lambda x: x <> 0)) AS BIGINT) >> i) & 1 AS VARCHAR))"
    return f"list_concat({counted}, flatten(list_transform(({some})[1:{last}], lambda v: list_concat(list_concat({unary}, {sign}), {rest}))))"


@query(f"""WITH {BLK}, t AS (SELECT vec_id, list_concat(list_concat({_tokens_sql(*_REGIONS[0])}, {_tokens_sql(*_REGIONS[1])}), {_tokens_sql(*_REGIONS[2])}) AS t FROM blk)
SELECT vec_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(t, ',')) AS md5 FROM t""")
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's tokens in the order of coding, by their digest."""
    told = F.transform("t", lambda x: F.concat(x["category"], F.lit(":"), x["bit"]))
    return blocks(spark, sf_dir).select("vec_id", G.token_list(F.col("coef")).alias("t")).select("vec_id", F.size("t").alias("n_tokens"), F.md5(F.array_join(told, ",")).alias("md5"))
