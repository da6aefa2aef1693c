"""Queries on what is refused, on packets as bytes, on saved state, and on the DC coefficient from pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.layouts import ALIGNED_TO_RASTER, COLUMN, COSINE, FREQUENCY_MAX, QUANT, RASTER_TO_ALIGNED, ROW
from ..operators import blocks as B
from ..operators import layout as Y
from ..operators import ledger as L
from ..operators import refusals as R
from ..operators import segments as G
from ..sources.views import blocks, events, table
from ..streaming.jobs import shared_folder
from .block_queries import BIN_SQL, NEAR
from .layout_queries import IMAGES, PACKETS, images
from .ledger_queries import totals
from .registry import BITLEN, BLK, query, sql_list

LIMITS = [(FREQUENCY_MAX[r] + QUANT[r] - 1) // QUANT[r] for r in ALIGNED_TO_RASTER]


@query("""WITH p AS (SELECT p_partkey AS image_id, 192 + p_partkey % 64 AS kind, 192 + p_size % 64 AS other, p_partkey % 11 = 0 AS shifted FROM part),
v AS (SELECT *, {kind} AS a, {other} AS b FROM p)
SELECT image_id, CASE WHEN shifted THEN 'no image' WHEN a IN ('unsupported', 'misplaced') THEN a WHEN kind <> 218 AND b IN ('unsupported', 'misplaced') THEN b WHEN a = 'unknown' OR kind <> 218 AND b = 'unknown' THEN 'unknown' ELSE 'ok' END AS verdict,
  CAST(CASE WHEN shifted OR a IN ('unsupported', 'misplaced') OR kind <> 218 AND b IN ('unsupported', 'misplaced') THEN 2 WHEN a = 'unknown' OR kind <> 218 AND b = 'unknown' THEN 1 ELSE 0 END AS INT) AS level FROM v""".format(
    **{
        k: f"CASE WHEN {k} IN {R.UNSUPPORTED} THEN 'unsupported' WHEN {k} IN {R.MISPLACED} THEN 'misplaced' WHEN {k} IN {R.KNOWN} THEN 'ok' ELSE 'unknown' END"
        for k in ("kind", "other")
    }
))
def refused_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with all sorts of markers, some not at the start: what each is refused for, and the error level."""
    some = lambda kind: F.concat(G.byte(0xFF), G.byte(kind), F.unhex(F.lit("0003AA")))
    raw = F.concat(F.unhex(F.when(F.col("p_partkey") % 11 == 0, "00FFD8").otherwise("FFD8")), some(192 + F.col("p_partkey") % 64), some(192 + F.col("p_size") % 64))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), raw.alias("raw"))
    told = rows.select("image_id", R.header_verdict(F.col("raw"), F.transform(G.segments(F.col("raw")), lambda s: s["kind"])).alias("verdict"))
    return told.withColumn("level", F.when(F.col("verdict") == "ok", 0).when(F.col("verdict") == "unknown", 1).otherwise(2))


COUNT_SQL = "len(list_filter(coef[{0}:{1}], lambda v: v <> 0))"


@query(f"""WITH {BLK},
t AS (SELECT vec_id, list_transform(coef, lambda v: v * (1 + vec_id % 150)) AS c, {COUNT_SQL.format(1, 49)} + vec_id % 8 AS i, {COUNT_SQL.format(ROW.start + 1, ROW.stop)} + vec_id % 3 AS r, {COUNT_SQL.format(COLUMN.start + 1, COLUMN.stop)} + vec_id % 2 AS k FROM blk),
z AS (SELECT *, list_transform(range(1, 65), lambda j: CASE WHEN abs(c[j]) > ({sql_list(LIMITS)})[j] THEN 0 ELSE c[j] END) AS kept FROM t)
SELECT vec_id, CASE WHEN i > 49 THEN 'interior' WHEN r > 7 THEN 'row' WHEN k > 7 THEN 'column' WHEN list_max(list_transform(c, lambda v: {BITLEN.format("v")})) > 11 THEN 'magnitude' ELSE 'ok' END AS verdict,
  CAST(len(list_filter(range(1, 65), lambda j: kept[j] <> c[j])) AS INT) AS zeroed, CAST(list_sum(kept) AS BIGINT) AS kept FROM z""")
def refused_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks told with too many nonzeros or too large values, and what is left when values out of range are zeroed."""
    k = F.col("vec_id")
    told = [B.nonzeros(F.col("coef"), first, n) + k % more for first, n, more in ((0, 49, 8), (ROW.start, 7, 3), (COLUMN.start, 7, 2))]
    rows = blocks(spark, sf_dir).select("vec_id", F.transform("coef", lambda v: v * (1 + k % 150)).alias("c"), *(c.alias(n) for c, n in zip(told, ("i", "r", "k"), strict=True)))
    rows = rows.withColumn("kept", R.in_range(F.col("c"), LIMITS))
    zeroed = F.size(F.filter(F.zip_with("c", "kept", lambda a, b: a != b), lambda x: x))
    return rows.select("vec_id", R.block_verdict(F.col("c"), F.col("i"), F.col("r"), F.col("k")).alias("verdict"), zeroed.alias("zeroed"), F.aggregate("kept", F.lit(0).cast("long"), lambda s, v: s + v).alias("kept"))


WRAP_SQL = "CASE WHEN {0} < -1024 THEN {0} + 2049 WHEN {0} > 1024 THEN {0} - 2049 ELSE {0} END"


@query(f"""WITH {BLK},
d AS (SELECT image_id, bx, coef[50] * 90 AS v, coalesce(lag(coef[50] * 90) OVER (PARTITION BY image_id, "by" ORDER BY bx), 0) AS p FROM blk),
r AS (SELECT *, {WRAP_SQL.format("(v - p)")} AS residual FROM d),
b AS (SELECT *, {WRAP_SQL.format("(p + residual)")} AS back FROM r)
SELECT image_id, count(*) AS n, count(*) FILTER (back <> v) AS refused, CAST(sum(abs(residual)) AS BIGINT) AS residuals, CAST(sum(back) AS BIGINT) AS restored FROM b GROUP BY image_id""")
def wrap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped residuals of (ninetyfold) DC values from their left neighbours, and the values that don't come back."""
    near = B.with_neighbours(blocks(spark, sf_dir), dc=(F.get("coef", 49) * 90).cast("long"))
    rows = near.select("image_id", F.col("dc").alias("v"), F.coalesce("left_dc", F.lit(0).cast("long")).alias("p"))
    back = R.wrapped_back(F.col("v"), F.col("p"))
    rows = rows.withColumns({"residual": bits.wrapped_residual(F.col("v") - F.col("p")), "back": back})
    return rows.groupBy("image_id").agg(F.count("*").alias("n"), F.sum((F.col("back") != F.col("v")).cast("long")).alias("refused"), F.sum(F.abs("residual")).alias("residuals"), F.sum("back").alias("restored"))


@query(f"""WITH {PACKETS},
b AS (
  SELECT doc_id // 16 AS file_no, doc_id % 16 AS stream, round, len,
    CASE WHEN len IN (4096, 16384, 65536) THEN lpad(hex(CAST(doc_id % 16 + 16 * CASE len WHEN 4096 THEN 1 WHEN 16384 THEN 2 ELSE 3 END AS BIGINT)), 2, '0')
      ELSE lpad(hex(CAST(doc_id % 16 AS BIGINT)), 2, '0') || lpad(hex(CAST((len - 1) % 256 AS BIGINT)), 2, '0') || lpad(hex(CAST((len - 1) // 256 AS BIGINT)), 2, '0') END || substr(hex(encode(text)), CAST(2 * start + 1 AS BIGINT), CAST(2 * len AS BIGINT)) AS h FROM k)
SELECT file_no, md5(string_agg(h, '' ORDER BY round, stream) || 'FFFEFF') AS md5, CAST(sum(length(h)) // 2 + 3 AS BIGINT) AS n_bytes, CAST(count(*) AS INT) AS n_packets, CAST(count(DISTINCT stream) AS INT) AS streams, TRUE AS equal FROM b GROUP BY file_no""")
def mux_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of up to sixteen documents as streams: their packets written as bytes in turns, parsed again, and compared stream by stream."""
    docs = table(spark, sf_dir, "documents").select(bits.int_div(F.col("doc_id"), 16).alias("file_no"), (F.col("doc_id") % 16).cast("int").alias("stream"), F.encode("text", "UTF-8").alias("raw"))
    piece = lambda p: F.struct(p["round"].alias("round"), F.col("stream"), Y.packet_bytes(F.col("stream"), F.substring(F.col("raw"), p["start"].cast("int") + 1, p["len"].cast("int"))).alias("b"))
    cut = docs.select("file_no", "stream", F.md5("raw").alias("own"), F.transform(Y.packet_list(F.length("raw").cast("long")), piece).alias("p")).where(F.size("p") > 0)
    latin = lambda b: F.decode(b, "ISO-8859-1")
    ordered = F.array_sort(F.flatten(F.collect_list("p")))
    files = cut.groupBy("file_no").agg(F.encode(F.concat(F.array_join(F.transform(ordered, lambda x: latin(x["b"])), ""), latin(F.unhex(F.lit(Y.END_OF_FILE)))), "ISO-8859-1").alias("raw"), F.array_sort(F.collect_list(F.struct("stream", "own"))).alias("own"))
    read = files.select("file_no", "raw", "own", Y.parsed_packets(F.col("raw")).alias("p"))
    body = lambda k: F.array_join(F.transform(F.filter("p", lambda x: x["stream"] == k), lambda x: latin(F.substring(F.col("raw"), x["start"] + 1, x["len"]))), "")
    equal = F.forall("own", lambda s: F.md5(F.encode(body(s["stream"]), "ISO-8859-1")) == s["own"])
    return read.select("file_no", F.md5(F.hex("raw")).alias("md5"), F.length("raw").cast("long").alias("n_bytes"), F.size("p").alias("n_packets"), F.size("own").alias("streams"), equal.alias("equal"))


@query("""WITH s AS (SELECT l_suppkey, list(DISTINCT CAST(l_quantity AS BIGINT) % 16 * 16 + l_partkey % 3) AS symbols FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CAST(len(symbols) AS INT) AS symbols, CAST(coalesce((2 << list_max(list_transform(list_filter(symbols, lambda s: s % 16 = 0 AND s < 240), lambda s: s // 16))) - 1, 0) AS BIGINT) AS longest FROM s""")
def run_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of ended blocks that each supplier's table of symbols can code."""
    symbols = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_quantity").cast("long") % 16 * 16 + F.col("l_partkey") % 3).alias("s"))
    return symbols.select("l_suppkey", F.size("s").alias("symbols"), R.longest_run(F.col("s")).alias("longest"))


@query("""WITH x AS (SELECT l_partkey * 97 % 1048576 AS x, l_suppkey % 1023 + 1 AS d FROM lineitem)
SELECT d, count(*) AS n, CAST(sum(x // d) AS BIGINT) AS quotients, CAST(max(x - x // d * d) AS BIGINT) AS most_rest FROM x GROUP BY d""")
def reciprocal_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotients by multiplication with a reciprocal, and the largest remainder of each divisor."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 97 % (1 << 20)).alias("x"), (F.col("l_suppkey") % 1023 + 1).alias("d"))
    rows = rows.withColumn("q", R.reciprocal_div(F.col("x"), F.col("d")))
    return rows.groupBy("d").agg(F.count("*").alias("n"), F.sum("q").alias("quotients"), F.max(F.col("x") - F.col("q") * F.col("d")).alias("most_rest"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '-' ELSE '' END || CAST(event_id % 1000 AS VARCHAR) || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.5' WHEN 2 THEN '.' ELSE '.2.5' END AS s FROM events)
SELECT event_id, s, regexp_matches(s, '^[0-9]+(\\.[0-9]*)?$') AS valid, CASE WHEN regexp_matches(s, '^[0-9]+(\\.[0-9]*)?$') THEN CAST(event_id % 1000 AS DOUBLE) + CASE WHEN event_id % 4 = 1 THEN 0.5 ELSE 0 END END AS number FROM t""")
def numeric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of digits and dots as numbers, and those refused, such as signed ones."""
    k = F.col("event_id")
    s = F.concat(F.when(k % 5 == 0, "-").otherwise(""), (k % 1000).cast("string"), F.get(F.array(*map(F.lit, ("", ".5", ".", ".2.5"))), (k % 4).cast("int")))
    rows = table(spark, sf_dir, "events").select("event_id", s.alias("s")).withColumn("number", R.numeric_text(F.col("s")))
    return rows.select("event_id", "s", F.col("number").isNotNull().alias("valid"), "number")


@query(f"""WITH {IMAGES},
f AS (SELECT image_id, component, component + 1 + image_id % 3 AS jid, sh * sv AS blocks FROM g),
s AS (SELECT image_id, place, 1 + image_id % 3 + (place + image_id) % 4 AS jid FROM (SELECT DISTINCT image_id FROM g), (SELECT CAST(unnest(range(3)) AS INT) AS place) WHERE TRUE)
SELECT s.image_id, s.place, CAST(s.jid AS BIGINT) AS jid, f.component, coalesce(f.blocks, 0) AS blocks FROM s LEFT JOIN f ON f.image_id = s.image_id AND f.jid = s.jid""")
def scan_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components that each image's scan names by id; null where a frame has no such id."""
    frame = images(spark, sf_dir).select("image_id", "component", (F.col("component") + 1 + F.col("image_id") % 3).alias("jid"), (F.col("sh") * F.col("sv")).cast("int").alias("blocks"))
    scan = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("place"))
    scan = scan.withColumn("jid", 1 + F.col("image_id") % 3 + (F.col("place") + F.col("image_id")) % 4)
    return scan.join(frame, ["image_id", "jid"], "left").select("image_id", "place", "jid", "component", F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query("""WITH x AS (SELECT event_type, user_id % 64 AS slot, count(*) FILTER (event_id % 3 <> 0) AS f, count(*) FILTER (event_id % 3 = 0) AS t FROM events GROUP BY ALL)
SELECT event_type, slot, f, t, CAST(256 * (f + 1) // (f + t + 2) AS BIGINT) AS p, (f + 1) // 2 AS half_f, (t + 1) // 2 AS half_t, TRUE AS equal FROM x""")
def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot counts saved as a model file and loaded again: probabilities, counts halved for a new start, and whether the file gives back what was saved."""
    folder = shared_folder(spark)
    model = totals(spark, sf_dir).withColumn("p", L.implied(F.col("f"), F.col("t")))
    model.write.parquet(folder)
    loaded = spark.read.parquet(folder)
    same = model.select("event_type", "slot", F.struct("f", "t", "p").alias("saved"))
    halved = [bits.int_div(F.col(c) + 1, 2).alias(f"half_{c}") for c in ("f", "t")]
    return loaded.join(same, ["event_type", "slot"], "left").select("event_type", "slot", "f", "t", "p", *halved, F.coalesce(F.col("saved") == F.struct("f", "t", "p"), F.lit(False)).alias("equal"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(event_id % 7 * 60000 + CAST(floor(abs(value) * 1000) AS BIGINT) % 60000) AS BIGINT) AS ms, CAST(max(event_id % 7 * 60000 + CAST(floor(abs(value) * 1000) AS BIGINT) % 60000) AS BIGINT) AS longest
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def time_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as lines of a log, with others among them, and the real ones read back from the text."""
    ms = F.floor(F.abs("value") * 1000).cast("long") % 60_000
    stamp = lambda name: F.concat(F.lit(f"{name}\t"), F.col("event_id") % 7, F.lit("m"), bits.int_div(ms, 1000), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("s\t"), F.col("event_type"))
    folder = shared_folder(spark)
    lines = events(spark, sf_dir).where("value is not null").select(F.explode(F.array(stamp("real"), stamp("user"), stamp("sys"), F.lit(""))).alias("value"))
    lines.write.text(folder)
    real = spark.read.text(folder).where(F.startswith("value", F.lit("real")))
    part = lambda k, kind: F.regexp_extract("value", r"^real\t(\d+)m(\d+)\.(\d{3})s\t(.*)$", k).cast(kind)
    told = real.select(part(4, "string").alias("event_type"), (part(1, "long") * 60_000 + part(2, "long") * 1000 + part(3, "long")).alias("ms"))
    return told.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"), F.max("ms").alias("longest"))


Q0 = QUANT[0]
_COSINES = sql_list([c for row in COSINE for c in row])
_RASTER = sql_list([p + 1 for p in RASTER_TO_ALIGNED])


@query(f"""WITH {BLK},
basis AS (SELECT CAST(u AS INT) AS u, CAST(x AS INT) AS x, CAST(({_COSINES})[8 * u + x + 1] AS BIGINT) AS w FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS x) WHERE TRUE),
f AS (SELECT vec_id, pos // 8 AS v, pos % 8 AS u, CASE WHEN pos = 0 THEN 0 ELSE c END AS c FROM (SELECT vec_id, unnest(list_transform({_RASTER}, lambda i: coef[i])) AS c, unnest(range(64)) AS pos FROM blk)),
h AS (SELECT vec_id, v, x, sum(c * w) AS s FROM f JOIN basis USING (u) GROUP BY vec_id, v, x),
x AS (SELECT h.vec_id, b.x AS y, h.x, CAST(sum(h.s * b.w) AS BIGINT) // 67108864 AS p FROM h JOIN basis b ON b.u = h.v GROUP BY ALL),
a AS (SELECT vec_id, list(p ORDER BY 8 * y + x) AS p FROM x GROUP BY vec_id),
e AS (
  SELECT blk.vec_id, image_id, "by", bx, coef[50] AS dc, p, list_transform(range(1, 9), lambda i: coef[50] * {Q0} + p[8 * i] + 1024 + (p[8 * i] - p[8 * i - 1]) // 2) AS r,
    list_transform(range(1, 9), lambda i: coef[50] * {Q0} + p[56 + i] + 1024 + (p[56 + i] - p[48 + i]) // 2) AS d FROM blk JOIN a USING (vec_id)),
n AS (
  SELECT e.vec_id, e.dc, list_transform(range(1, 9), lambda i: l.r[i] - (e.p[8 * i - 7] - e.p[8 * i - 6]) // 2 - e.p[8 * i - 7] - 1024) AS lx, l.vec_id IS NOT NULL AS hl,
    list_transform(range(1, 9), lambda i: t.d[i] - (e.p[i] - e.p[i + 8]) // 2 - e.p[i] - 1024) AS tx, t.vec_id IS NOT NULL AS ht
  FROM e LEFT JOIN e l ON l.image_id = e.image_id AND l."by" = e."by" AND l.bx = e.bx - 1 LEFT JOIN e t ON t.image_id = e.image_id AND t.bx = e.bx AND t."by" = e."by" - 1),
s AS (
  SELECT *, CAST(coalesce(list_sum(CASE WHEN hl THEN lx ELSE tx END), 0) AS BIGINT) AS s0, CAST(coalesce(list_sum(CASE WHEN ht THEN tx ELSE lx END), 0) AS BIGINT) AS s1,
    CASE WHEN hl AND ht THEN list_concat(lx, tx) WHEN hl THEN lx WHEN ht THEN tx END AS every FROM n),
m AS (SELECT *, CAST(floor((s0 + s1) / 2.0) AS BIGINT) AS mean FROM s)
SELECT vec_id, CAST(floor((mean // {Q0} + 4) / 8.0) AS BIGINT) AS predicted, CAST(coalesce(floor((list_max(every) - list_min(every)) / 8.0), 0) AS BIGINT) AS spread,
  CAST(floor(CASE WHEN abs(s0 - mean) < abs(s1 - mean) THEN s0 - mean ELSE s1 - mean END / 8.0) AS BIGINT) AS "offset", dc - CAST(floor((mean // {Q0} + 4) / 8.0) AS BIGINT) AS error FROM m""")
def pixel_dc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DC coefficient of every block predicted from the pixels beyond its neighbours' edges."""
    p = blocks(spark, sf_dir).select("vec_id", "image_id", "by", "bx", F.get("coef", 49).alias("dc"), B.pixels_without_dc(F.col("coef")).alias("p"))
    near = B.with_neighbours(p, e=B.edge_pixels(F.col("p"), (F.col("dc") * Q0).cast("long")))
    guess = B.dc_from_pixels(F.col("p"), F.col("left_e.right"), F.col("above_e.below"), Q0)
    return near.select("vec_id", "dc", guess.alias("g")).select("vec_id", "g.*", (F.col("dc") - F.col("g.predicted")).alias("error"))


CONTEXT_SQL = """CASE WHEN l IS NOT NULL AND a IS NOT NULL THEN (len(list_filter(l[1:49], lambda v: v <> 0)) + len(list_filter(a[1:49], lambda v: v <> 0)) + 2) // 4
  WHEN l IS NOT NULL THEN (len(list_filter(l[1:49], lambda v: v <> 0)) + 1) // 2 WHEN a IS NOT NULL THEN (len(list_filter(a[1:49], lambda v: v <> 0)) + 1) // 2 ELSE 0 END"""


@query(f"""WITH {NEAR},
x AS (SELECT CAST({CONTEXT_SQL} AS INT) AS ctx, CAST(len(list_filter(coef[1:49], lambda v: v <> 0)) AS BIGINT) AS k FROM n),
b AS (SELECT CAST({BIN_SQL} AS INT) AS bin, k, unnest(range(6)) AS place FROM x)
SELECT bin, CAST(place AS INT) AS place, CAST(k >> (place + 1) AS BIGINT) AS higher, count(*) FILTER ((k >> place) & 1 = 0) AS f, count(*) FILTER ((k >> place) & 1 = 1) AS t FROM b GROUP BY ALL""")
def count_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six bits of each interior count by the slot that codes them: the neighbours' expected count, the bit's place, and the bits above it."""
    near = B.with_neighbours(blocks(spark, sf_dir), n=B.nonzeros(F.col("coef"), 0, 49)).select("n", B.count_bin(B.count_context(F.col("left_n"), F.col("above_n"))).alias("bin"))
    shift = lambda by: F.call_function("shiftright", F.col("n"), by)
    rows = near.select("bin", "n", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("place"))
    rows = rows.select("bin", "place", shift(F.col("place") + 1).cast("long").alias("higher"), (shift(F.col("place")) % 2).alias("bit"))
    count = lambda bit: F.sum((F.col("bit") == bit).cast("long"))
    return rows.groupBy("bin", "place", "higher").agg(count(0).alias("f"), count(1).alias("t"))


@query(f"""WITH {BLK},
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY "by", bx) - 1 AS place, count(*) OVER (PARTITION BY image_id) * (1 + image_id % 4) // 5 AS bound FROM blk),
z AS (SELECT image_id, vec_id, place < bound AS kept, bound, CASE WHEN place < bound THEN coef ELSE list_transform(coef, lambda v: 0) END AS c FROM k)
SELECT image_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS made, CAST(any_value(bound) AS BIGINT) AS bound, CAST(sum(list_sum(c)) AS BIGINT) AS total, CAST(max(CASE WHEN kept THEN vec_id END) AS BIGINT) AS last FROM z GROUP BY image_id""")
def truncated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that end early: the bound on their blocks is kept, and the blocks beyond it are made up of zeros."""
    image = Window.partitionBy("image_id")
    rows = blocks(spark, sf_dir).withColumn("place", F.row_number().over(image.orderBy("by", "bx")) - 1).withColumn("bound", bits.int_div(F.count("*").over(image) * (1 + F.col("image_id") % 4), 5))
    rows = rows.withColumn("kept", F.col("place") < F.col("bound"))
    rows = rows.withColumn("c", F.when(F.col("kept"), F.col("coef")).otherwise(F.transform("coef", lambda v: F.lit(0))))
    count = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("image_id").agg(count(F.col("kept")).alias("kept"), count(~F.col("kept")).alias("made"), F.first("bound").alias("bound"), F.sum(F.aggregate("c", F.lit(0).cast("long"), lambda s, v: s + v)).alias("total"), F.max(F.when(F.col("kept"), F.col("vec_id"))).alias("last"))
