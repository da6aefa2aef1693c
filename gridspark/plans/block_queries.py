"""Queries over blocks of coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.layouts import ALIGNED_TO_RASTER, COSINE, COUNT_BINS, FREQUENCY_MAX, NOISE_FLOOR, QUANT, RASTER_TO_ALIGNED, ZIGZAG_TO_ALIGNED
from ..operators import blocks as B
from ..sources.views import blocks, coefficients
from .registry import BITLEN, BLK, query, sql_list

X49, Y49 = sql_list([r % 8 for r in ALIGNED_TO_RASTER[:49]]), sql_list([r // 8 for r in ALIGNED_TO_RASTER[:49]])


@query(f"""WITH {BLK}
SELECT vec_id, CAST(len(list_filter(coef[1:49], lambda x: x <> 0)) AS INT) AS interior,
  CAST(len(list_filter(coef[51:57], lambda x: x <> 0)) AS INT) AS edge_row, CAST(len(list_filter(coef[58:64], lambda x: x <> 0)) AS INT) AS edge_column,
  CAST(list_max(list_transform(range(1, 50), lambda i: CASE WHEN coef[i] <> 0 THEN ({X49})[i] ELSE 0 END)) AS INT) AS eob_x,
  CAST(list_max(list_transform(range(1, 50), lambda i: CASE WHEN coef[i] <> 0 THEN ({Y49})[i] ELSE 0 END)) AS INT) AS eob_y,
  CAST(list_max(list_transform(range(1, 65), lambda i: CASE WHEN coef[i] <> 0 THEN i - 1 ELSE 0 END)) AS INT) AS last_nonzero
FROM blk""")
def block_nonzero_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("coef")
    return blocks(spark, sf_dir).select(
        "vec_id",
        B.nonzeros(c, 0, 49).alias("interior"),
        B.nonzeros(c, 50, 7).alias("edge_row"),
        B.nonzeros(c, 57, 7).alias("edge_column"),
        B.furthest(c, "x").alias("eob_x"),
        B.furthest(c, "y").alias("eob_y"),
        B.last_nonzero(c).alias("last_nonzero"),
    )


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficients(blocks(spark, sf_dir)).groupBy(B.position_class(F.col("pos")).alias("class"), F.col("v").alias("value")).agg(F.count("*").alias("cnt"))


HISTOGRAM = f"""{BLK},
h AS (
  SELECT CASE WHEN pos < 49 THEN '7x7' WHEN pos = 49 THEN 'dc' ELSE 'edge' END AS class, v AS value, count(*) AS cnt
  FROM (SELECT unnest(coef) AS v, unnest(range(64)) AS pos FROM blk) GROUP BY ALL)"""


@query(f"WITH {HISTOGRAM} SELECT class, value, cnt FROM h")
def coef_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(spark, sf_dir)


L_SQL = BITLEN.format("value")


@query(f"""WITH {HISTOGRAM},
c AS (
  SELECT class, cnt, value, CAST({L_SQL} AS BIGINT) AS l FROM h),
costs AS (
  SELECT class, 'unary_exp' AS code, cnt * CASE WHEN l = 0 THEN 1 WHEN l < 10 THEN 2 * l + 1 WHEN l = 10 THEN 20 END AS cost FROM c
  UNION ALL SELECT class, 'unary0exp', cnt * CASE WHEN l = 0 THEN 1 WHEN value = 1 THEN 2 WHEN value = -1 THEN 3 WHEN l < 10 THEN 2 * l + 2 WHEN l = 10 THEN 21 END FROM c
  UNION ALL SELECT class, 'binaryexp', cnt * CASE WHEN l = 0 THEN 2 WHEN l <= 10 THEN l + 4 END FROM c
  UNION ALL SELECT class, 'unary', cnt * CASE WHEN value = 0 THEN 1 ELSE abs(value) + 2 END FROM c
  UNION ALL SELECT class, 'untrunc' || lpad(CAST(n AS VARCHAR), 2, '0'),
    cnt * CASE WHEN value = 0 THEN 1 WHEN abs(value) <= n THEN abs(value) + 2 ELSE 2 * length(bin(abs(value) - n)) + 1 + n END
    FROM c, (SELECT unnest(range(20)) AS n) WHERE TRUE
  UNION ALL SELECT class, 'pure_bin', sum(cnt) * CASE WHEN max(value) <= 0 THEN 0 ELSE length(bin(max(value))) END FROM c GROUP BY class)
SELECT class, code, CAST(sum(cost) AS BIGINT) AS cost FROM costs GROUP BY class, code""")
def int_code_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of 25 integer codes would spend on the histogram of each class."""
    v, size = F.col("value"), F.col("l")
    most = F.max("value").over(Window.partitionBy("class"))  # of the histogram, which has a row per value
    h = histogram(spark, sf_dir).withColumn("l", bits.bit_length(v)).withColumn("most", most)
    plain = F.when(v == 0, 1).otherwise(F.abs(v) + 2)
    codes = {
        "unary_exp": F.when(size == 0, 1).when(size < 10, 2 * size + 1).when(size == 10, 20),
        "unary0exp": F.when(size == 0, 1).when(v == 1, 2).when(v == -1, 3).when(size < 10, 2 * size + 2).when(size == 10, 21),
        "binaryexp": F.when(size == 0, 2).when(size <= 10, size + 4),
        "unary": plain,
        **{f"untrunc{n:02d}": F.when(F.abs(v) <= n, plain).otherwise(2 * bits.bit_length(F.abs(v) - n) + 1 + n) for n in range(20)},
        "pure_bin": bits.bit_length(F.greatest("most", F.lit(0))),
    }
    coded = h.select("class", "cnt", F.explode(F.array(*(F.struct(F.lit(k).alias("code"), c.cast("long").alias("each")) for k, c in codes.items()))).alias("x")).select("class", "cnt", "x.*")
    return coded.groupBy("class", "code").agg(F.sum(F.col("cnt") * F.col("each")).alias("cost"))


QT_SQL = ", ".join(f"({p}, {QUANT[r]}, {(FREQUENCY_MAX[r] + QUANT[r] - 1) // QUANT[r]})" for p, r in enumerate(ALIGNED_TO_RASTER))


@query(f"""WITH {BLK}, qt(pos, q, lim) AS (VALUES {QT_SQL})
SELECT pos, count(*) AS n, CAST(sum(v // q) AS BIGINT) AS levels, CAST(sum(abs(v - (v // q) * q)) AS BIGINT) AS error,
  CAST(count(*) FILTER (abs(v) > lim) AS BIGINT) AS over, CAST(any_value(length(bin(lim))) AS INT) AS limit_bits,
  CAST(any_value(greatest(0, length(bin(lim)) - {NOISE_FLOOR})) AS INT) AS noise
FROM (SELECT unnest(coef) AS v, CAST(unnest(range(64)) AS INT) AS pos FROM blk) JOIN qt USING (pos) GROUP BY pos""")
def quantize_dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, rounding error and range faults by position; the 64-row table is broadcast."""
    level = bits.int_div(F.col("v"), F.col("q"))
    rows = coefficients(blocks(spark, sf_dir)).join(F.broadcast(B.quant_table(spark)), "pos")
    return rows.groupBy("pos").agg(
        F.count("*").alias("n"),
        F.sum(level).alias("levels"),
        F.sum(F.abs(F.col("v") - level * F.col("q"))).cast("long").alias("error"),
        F.sum((F.abs("v") > F.col("limit")).cast("long")).alias("over"),
        F.first("limit_bits").alias("limit_bits"),
        F.first("noise").alias("noise"),
    )


Z2A = sql_list([p + 1 for p in ZIGZAG_TO_ALIGNED])
R2A = sql_list([p + 1 for p in RASTER_TO_ALIGNED])


@query(f"""WITH {BLK}
SELECT vec_id, array_to_string(list_transform({Z2A}, lambda i: coef[i]), ' ') AS zigzag, array_to_string(list_transform({R2A}, lambda i: coef[i]), ' ') AS raster FROM blk""")
def zigzag_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda order: F.array_join(B.permuted(F.col("coef"), order).cast("array<string>"), " ")
    return blocks(spark, sf_dir).select("vec_id", text(ZIGZAG_TO_ALIGNED).alias("zigzag"), text(RASTER_TO_ALIGNED).alias("raster"))


NEAR = f"""{BLK},
n AS (
  SELECT b.*, l.coef AS l, a.coef AS a, c.coef AS c FROM blk b
  LEFT JOIN blk l ON l.image_id = b.image_id AND l.by = b.by AND l.bx = b.bx - 1
  LEFT JOIN blk a ON a.image_id = b.image_id AND a.by = b.by - 1 AND a.bx = b.bx
  LEFT JOIN blk c ON c.image_id = b.image_id AND c.by = b.by - 1 AND c.bx = b.bx - 1)"""

BIN_SQL = "CASE " + " ".join(f"WHEN ctx >= {s} THEN {k}" for k, s in reversed(list(enumerate(COUNT_BINS)))) + " END"


@query(f"""WITH {NEAR},
x AS (
  SELECT vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE
      WHEN l IS NOT NULL AND a IS NOT NULL THEN ((13 * (abs(l[i]) + abs(a[i])) + 6 * coalesce(abs(c[i]), 0)) & 65535) >> 5
      ELSE coalesce(abs(l[i]), abs(a[i]), 0) END)) AS BIGINT) AS magnitude,
    CAST(CASE WHEN l IS NOT NULL AND a IS NOT NULL THEN (len(list_filter(l[1:49], lambda v: v <> 0)) + len(list_filter(a[1:49], lambda v: v <> 0)) + 2) // 4
      WHEN l IS NOT NULL THEN (len(list_filter(l[1:49], lambda v: v <> 0)) + 1) // 2
      WHEN a IS NOT NULL THEN (len(list_filter(a[1:49], lambda v: v <> 0)) + 1) // 2 ELSE 0 END AS INT) AS ctx FROM n)
SELECT vec_id, magnitude, ctx AS context, CAST({BIN_SQL} AS INT) AS bin FROM x""")
def neighbor_weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = B.with_neighbours(blocks(spark, sf_dir), c=F.col("coef"), n=B.nonzeros(F.col("coef"), 0, 49))
    places = F.sequence(F.lit(0), F.lit(63))
    mean = F.aggregate(places, F.lit(0).cast("long"), lambda s, i: s + B.weighted_magnitude(F.get("left_c", i), F.get("above_c", i), F.coalesce(F.get("corner_c", i), F.lit(0))).cast("long"))
    out = near.select("vec_id", mean.alias("magnitude"), B.count_context(F.col("left_n"), F.col("above_n")).alias("context"))
    return out.withColumn("bin", B.count_bin(F.col("context")))


@query(f"""WITH {NEAR},
d AS (SELECT image_id, coef[50] AS v, l[50] AS l, a[50] AS a, c[50] AS c FROM n),
p AS (
  SELECT *, CASE WHEN l IS NOT NULL AND a IS NOT NULL THEN CASE WHEN c >= greatest(l, a) THEN least(l, a) WHEN c <= least(l, a) THEN greatest(l, a) ELSE l + a - c END
    ELSE coalesce(l, a, 0) END AS p FROM d)
SELECT image_id, count(*) AS n, CAST(sum(abs(p - v)) AS BIGINT) AS median_error, CAST(sum(abs(coalesce(l, 0) - v)) AS BIGINT) AS left_error,
  CAST(sum(abs(coalesce((l + a) // 2, l, a, 0) - v)) AS BIGINT) AS mean_error,
  CAST(sum(CASE WHEN v * 100 - p * 100 < -1024 THEN v * 100 - p * 100 + 2049 WHEN v * 100 - p * 100 > 1024 THEN v * 100 - p * 100 - 2049 ELSE v * 100 - p * 100 END) AS BIGINT) AS wrapped
FROM p GROUP BY image_id""")
def loco_dc_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of three predictors of the DC coefficient by image, and the sum of wrapped residuals (of hundredfold values)."""
    near = B.with_neighbours(blocks(spark, sf_dir), dc=F.get("coef", 49))
    v, left, above = F.col("dc"), F.col("left_dc"), F.col("above_dc")
    rows = near.withColumn("p", B.median_edge(left, above, F.col("corner_dc")))
    err = lambda x: F.sum(F.abs(x - v)).cast("long")
    return rows.groupBy("image_id").agg(
        F.count("*").alias("n"),
        err(F.col("p")).alias("median_error"),
        err(F.coalesce(left, F.lit(0))).alias("left_error"),
        err(F.coalesce(bits.int_div(left + above, 2), left, above, F.lit(0))).alias("mean_error"),
        F.sum(bits.wrapped_residual(100 * (v - F.col("p")))).cast("long").alias("wrapped"),
    )


def _edge_sql(band: int, across: bool) -> str:
    at = [band + 8 * i if across else 8 * band + i for i in range(8)]
    w = [COSINE[i][0] * QUANT[r] for i, r in enumerate(at)]
    side = "a" if across else "l"
    terms = "".join(f" - {w[i]} * (coef[{RASTER_TO_ALIGNED[at[i]] + 1}] {'+' if i % 2 else '-'} {side}[{RASTER_TO_ALIGNED[at[i]] + 1}])" for i in range(1, 8))
    return f"SELECT vec_id, '{'row' if across else 'column'}' AS edge, {band} AS band, CAST(coalesce((CAST({side}[{RASTER_TO_ALIGNED[at[0]] + 1}] AS BIGINT) * {w[0]}{terms}) // {w[0]}, 0) AS BIGINT) AS predicted FROM n"


@query(f"WITH {NEAR} " + " UNION ALL ".join(_edge_sql(b, across) for across in (True, False) for b in range(1, 8)))
def lakhani_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the 14 edge coefficients of every block; 0 where the neighbour is absent."""
    near = B.with_neighbours(blocks(spark, sf_dir), c=F.col("coef"))
    cases = [
        F.struct(F.lit("row" if across else "column").alias("edge"), F.lit(b).alias("band"), F.coalesce(B.edge_prediction(F.col("coef"), F.col("above_c" if across else "left_c"), b, across), F.lit(0)).cast("long").alias("predicted"))
        for across in (True, False)
        for b in range(1, 8)
    ]
    return near.select("vec_id", F.explode(F.array(*cases)).alias("x")).select("vec_id", "x.*")


@query(f"""WITH {BLK},
basis AS (SELECT CAST(u AS INT) AS u, CAST(x AS INT) AS x, CAST(({sql_list([c for row in COSINE for c in row])})[8 * u + x + 1] AS BIGINT) AS w FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS x) WHERE TRUE),
f AS (SELECT vec_id, pos // 8 AS v, pos % 8 AS u, c FROM (SELECT vec_id, unnest(list_transform({R2A}, lambda i: coef[i])) AS c, unnest(range(64)) AS pos FROM blk)),
h AS (SELECT vec_id, v, x, sum(c * w) AS s FROM f JOIN basis USING (u) GROUP BY vec_id, v, x),
p AS (SELECT h.vec_id, b.x AS y, h.x, CAST(sum(h.s * b.w) AS BIGINT) AS p FROM h JOIN basis b ON b.u = h.v GROUP BY ALL)
SELECT vec_id, min(p) AS least, max(p) AS most, CAST(sum(p) AS BIGINT) AS total, CAST(sum(p * (8 * y + x)) AS BIGINT) AS weighted FROM p GROUP BY vec_id""")
def idct_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse transform of every block, in scaled integers; least, largest, sum and position-weighted sum of its pixels."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    sums = lambda p: F.struct(F.array_min(p).alias("least"), F.array_max(p).alias("most"), total(p).alias("total"), total(F.transform(p, lambda x, i: x * i)).alias("weighted"))
    return blocks(spark, sf_dir).select("vec_id", B.once(B.pixels(F.col("coef")), sums).alias("s")).select("vec_id", "s.*")


@query(f"""WITH {BLK},
z AS (SELECT vec_id, unnest(list_transform({Z2A}, lambda i: coef[i])) AS v, CAST(unnest(range(64)) AS INT) AS pos FROM blk),
r AS (SELECT vec_id, pos, v, pos - lag(pos, 1, 0) OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS run FROM z WHERE v <> 0 AND pos > 0)
SELECT vec_id, pos, CAST(run // 16 AS INT) AS long_runs, CAST(run % 16 AS INT) AS run, CAST(length(bin(abs(v))) AS INT) AS size FROM r""")
def zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_symbols(spark, sf_dir)


def run_symbols(spark: SparkSession, sf_dir: str, value: bool = False) -> DataFrame:
    """Each nonzero AC coefficient in scan order with the zeros before it and its size class, and on request its value v."""
    scan = blocks(spark, sf_dir).select("vec_id", F.posexplode(B.permuted(F.col("coef"), ZIGZAG_TO_ALIGNED)).alias("pos", "v")).where("v <> 0 and pos > 0")
    run = F.col("pos") - F.lag("pos", 1, 0).over(Window.partitionBy("vec_id").orderBy("pos")) - 1
    return scan.withColumn("r", run).select("vec_id", "pos", bits.int_div(F.col("r"), 16).cast("int").alias("long_runs"), (F.col("r") % 16).alias("run"), bits.bit_length(F.col("v")).alias("size"), *(["v"] if value else []))


@query(f"""WITH {BLK}
SELECT vec_id, CAST(list_sum(list_transform(coef, lambda v: 1 + 2 * {BITLEN.format("v")})) AS BIGINT) AS cost,
  CAST(list_sum(list_sort(coef[1:16])[5:12]) AS BIGINT) AS middle_sum,
  CAST(list_min(coef[1:16]) AS INT) AS low, CAST(list_max(coef[1:16]) AS INT) AS high,
  CAST((list_max(coef[1:16]) - list_min(coef[1:16])) >> 3 AS INT) AS spread,
  CAST(CASE WHEN abs(list_min(coef[1:16]) * 16 - list_sum(coef[1:16])) < abs(list_max(coef[1:16]) * 16 - list_sum(coef[1:16])) THEN list_min(coef[1:16]) * 16 - list_sum(coef[1:16]) ELSE list_max(coef[1:16]) * 16 - list_sum(coef[1:16]) END AS BIGINT) AS nearer
FROM blk""")
def block_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding cost of a block, and spread, trimmed sum and nearer extreme of its first sixteen values."""
    first = F.slice("coef", 1, 16)
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    low, high = F.array_min(first), F.array_max(first)
    down, up = low * 16 - add(first), high * 16 - add(first)
    return blocks(spark, sf_dir).select(
        "vec_id",
        add(F.transform("coef", lambda v: 1 + 2 * bits.bit_length(v))).alias("cost"),
        add(F.slice(F.array_sort(first), 5, 8)).alias("middle_sum"),
        low.alias("low"),
        high.alias("high"),
        F.shiftright(high - low, 3).alias("spread"),
        F.when(F.abs(down) < F.abs(up), down).otherwise(up).cast("long").alias("nearer"),
    )


@query(f"""WITH {BLK},
z AS (SELECT vec_id, unnest(list_transform({Z2A}, lambda i: coef[i])) AS v, CAST(unnest(range(64)) AS INT) AS pos FROM blk),
p AS (SELECT CAST(unnest(range(4)) AS INT) AS plane)
SELECT plane, pos, count(*) FILTER ((abs(v) >> plane) & 1 = 1) AS ones, count(*) FILTER (abs(v) >> plane = 1) AS newly, count(*) FILTER (abs(v) >> plane > 1) AS corrections
FROM z, p WHERE TRUE GROUP BY plane, pos""")
def bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive approximation: by plane and scan position, set bits, coefficients first seen, and correction bits."""
    scan = blocks(spark, sf_dir).select(F.posexplode(B.permuted(F.col("coef"), ZIGZAG_TO_ALIGNED)).alias("pos", "v"))
    rows = scan.withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("top", F.expr("shiftright(abs(v), plane)"))
    count = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("plane", "pos").agg(count(F.col("top") % 2 == 1).alias("ones"), count(F.col("top") == 1).alias("newly"), count(F.col("top") > 1).alias("corrections"))


@query(f"""WITH {BLK},
e AS (SELECT vec_id, pos, v, {BITLEN.format("v")} AS size FROM (SELECT vec_id, unnest(coef) AS v, CAST(unnest(range(64)) AS INT) AS pos FROM blk))
SELECT vec_id, CAST(sum(size) AS BIGINT) AS n_bits, CAST(sum(CASE WHEN v > 0 THEN v ELSE v - 1 + (1 << size) END) AS BIGINT) AS envelopes,
  CAST(sum(CASE WHEN v < 0 THEN -(abs(v) >> 1) ELSE v >> 1 END) AS BIGINT) AS halves, CAST(sum(least(greatest(v, -3), 3)) AS BIGINT) AS clamped,
  CAST(sum((abs(v) >> 1) & 3) AS BIGINT) AS middle_bits, CAST(sum(v) AS BIGINT) AS restored
FROM e GROUP BY vec_id""")
def envelope_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-magnitude envelopes of the coefficients, and the values restored from them."""
    v, size = F.col("v").cast("long"), F.col("size")
    rows = coefficients(blocks(spark, sf_dir)).withColumn("size", bits.bit_length(F.col("v"))).withColumn("code", bits.to_envelope(v, size))
    return rows.groupBy("vec_id").agg(
        F.sum("size").alias("n_bits"),
        F.sum("code").alias("envelopes"),
        F.sum(bits.truncating_shift(v, 1)).alias("halves"),
        F.sum(bits.clamped(v, -3, 3)).alias("clamped"),
        F.sum(bits.bit_field(F.abs(v), 1, 2)).alias("middle_bits"),
        F.sum(bits.from_envelope(F.col("code"), size)).alias("restored"),
    )
