"""Queries that write bytes or text and read them again: stored streams, planes, tables of values, tagged records, frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import blocks as B
from ..operators import bytestreams as Z
from ..operators import containers as C
from ..operators import segments as G
from ..sources.views import blocks, coefficients, table
from ..streaming.jobs import shared_folder
from .block_queries import HISTOGRAM, histogram
from .byte_queries import DOC_BYTES
from .ledger_queries import TOTALS, totals
from .refusal_queries import _COSINES, _RASTER
from .registry import BLK, query


def le(x: str, size: int) -> str:
    """x as little-endian hex digits, in DuckDB."""
    return " || ".join(f"lpad(hex(CAST(({x}) // {256**k} % 256 AS BIGINT)), 2, '0')" for k in range(size))


@query(f"""WITH {DOC_BYTES},
a AS (SELECT doc_id, CAST((1 + sum(CAST('0x' || h AS INT))) % 65521 + 65536 * ((any_value(n) + sum((n - i) * CAST('0x' || h AS INT))) % 65521) AS BIGINT) AS adler FROM x GROUP BY doc_id),
d AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
k AS (SELECT *, unnest(range(greatest(1, (n + 65534) // 65535))) AS k FROM d),
c AS (SELECT doc_id, k, n, least(65535, n - k * 65535) AS len, substr(h, CAST(k * 131070 + 1 AS BIGINT), 131070) AS body FROM k),
s AS (SELECT doc_id, any_value(n) AS n, string_agg(CASE WHEN (k + 1) * 65535 >= n THEN '01' ELSE '00' END || {le("len", 2)} || {le("65535 - len", 2)} || body, '' ORDER BY k) AS body FROM c GROUP BY doc_id)
SELECT doc_id, md5('7801' || body || lpad(hex(coalesce(adler, 1)), 8, '0')) AS md5, CAST(length(body) // 2 + 6 AS BIGINT) AS size, TRUE AS equal FROM s LEFT JOIN a USING (doc_id)""")
def stored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as stored-block streams: chunk headers, chunks and checksum written, and the text read back from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = docs.join(Z.adler32(docs, "doc_id", "text"), "doc_id").select("doc_id", "text", C.stored_stream(F.encode("text", "UTF-8"), F.col("adler")).alias("raw"))
    same = C.stored_text(F.col("raw")) == F.encode("text", "UTF-8")
    return made.select("doc_id", F.md5(F.hex("raw")).alias("md5"), F.length("raw").cast("long").alias("size"), same.alias("equal"))


@query(f"""WITH {BLK},
basis AS (SELECT CAST(u AS INT) AS u, CAST(x AS INT) AS x, CAST(({_COSINES})[8 * u + x + 1] AS BIGINT) AS w FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS x) WHERE TRUE),
f AS (SELECT vec_id, pos // 8 AS v, pos % 8 AS u, c FROM (SELECT vec_id, unnest(list_transform({_RASTER}, lambda i: coef[i])) AS c, unnest(range(64)) AS pos FROM blk)),
h AS (SELECT vec_id, v, x, sum(c * w) AS s FROM f JOIN basis USING (u) GROUP BY vec_id, v, x),
p AS (SELECT h.vec_id, b.x AS y, h.x, least(255, greatest(0, 128 + CAST(sum(h.s * b.w) AS BIGINT) // 536870912)) AS p FROM h JOIN basis b ON b.u = h.v GROUP BY ALL)
SELECT vec_id, md5(hex(encode('P5 8 8 255' || chr(10))) || string_agg(lpad(hex(CAST(p AS BIGINT)), 2, '0'), '' ORDER BY 8 * y + x)) AS md5, CAST(sum(p) AS BIGINT) AS total FROM p GROUP BY vec_id""")
def plane_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's pixels as the bytes of a grey-scale image file."""
    image = lambda p: F.struct(C.grey_image(p, 8, 8).alias("raw"), p.alias("p"))
    made = blocks(spark, sf_dir).select("vec_id", B.once(C.grey_pixels(B.pixels(F.col("coef"))), image).alias("i"))
    return made.select("vec_id", F.md5(F.hex("i.raw")).alias("md5"), F.aggregate("i.p", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"WITH {HISTOGRAM} SELECT class, value, cnt, CAST(sum(cnt) OVER (PARTITION BY class) AS BIGINT) AS of_class FROM h")
def histogram_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram written as tab-separated text and read again, with each class's total."""
    folder = shared_folder(spark)
    histogram(spark, sf_dir).select("class", "value", "cnt").write.option("sep", "\t").csv(folder)
    rows = spark.read.schema("class string, value int, cnt long").option("sep", "\t").csv(folder)
    return rows.withColumn("of_class", F.sum("cnt").over(Window.partitionBy("class")))


@query(f"""WITH {BLK},
c AS (SELECT vec_id, pos, v FROM (SELECT vec_id, unnest(coef[1:49]) AS v, CAST(unnest(range(49)) AS INT) AS pos FROM blk)),
l AS (SELECT *, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id) - coalesce(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM c)
SELECT vec_id, CAST(sum(remaining) AS BIGINT) AS remaining, CAST(sum(remaining * pos) AS BIGINT) AS weighted, CAST(count(*) FILTER (remaining > 0) AS BIGINT) AS told FROM l GROUP BY vec_id""")
def nonzeros_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nonzeros each interior coefficient still has before it, itself included, along the order of coding."""
    rows = coefficients(blocks(spark, sf_dir)).where("pos < 49").withColumn("nz", (F.col("v") != 0).cast("long"))
    block = Window.partitionBy("vec_id")
    left = F.sum("nz").over(block) - F.coalesce(F.sum("nz").over(block.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.withColumn("remaining", left)
    return rows.groupBy("vec_id").agg(F.sum("remaining").alias("remaining"), F.sum(F.col("remaining") * F.col("pos")).alias("weighted"), F.sum((F.col("remaining") > 0).cast("long")).alias("told"))


@query(f"""WITH x AS ({TOTALS}), y AS (SELECT event_type, slot, f // 2 AS f, t + 3 AS t FROM x WHERE slot % 5 <> 0)
SELECT x.event_type, x.slot, CAST(256 * (x.f + 1) // (x.f + x.t + 2) AS BIGINT) AS p, CAST(256 * (y.f + 1) // (y.f + y.t + 2) AS BIGINT) AS other, abs(p - other) > 16 AS differs FROM x LEFT JOIN y ON x.event_type = y.event_type AND x.slot = y.slot""")
def model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a model beside those of another one, which lacks some, and which differ by over a sixteenth."""
    own = totals(spark, sf_dir)
    other = own.where("slot % 5 <> 0").select("event_type", "slot", F.expr("f div 2").alias("f"), (F.col("t") + 3).alias("t"))
    return C.compared(own, other, ["event_type", "slot"], 16)


@query(f"""WITH d AS (SELECT doc_id, hex(encode(source)) AS a, hex(encode(lang)) AS b, hex(encode(text)) AS c FROM documents),
r AS (SELECT doc_id, 'SRC' AS tag, a AS h, 0 AS k FROM d UNION ALL SELECT doc_id, 'LNG', b, 1 FROM d WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'TXT', c, 2 FROM d)
SELECT doc_id, md5(string_agg(hex(encode(tag)) || {le("length(h) // 2", 4)} || h, '' ORDER BY k)) AS md5, CAST(count(*) AS INT) AS records, string_agg(tag || ':' || CAST(length(h) // 2 AS VARCHAR), ',' ORDER BY k) AS told, TRUE AS equal FROM r GROUP BY doc_id""")
def tagged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as containers of records, each a tag, a length and a body; some tags are missing. Written, and parsed again."""
    raw = lambda c: F.encode(c, "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    records = F.array_compact(F.array(C.record("SRC", raw("source")), F.when(F.col("doc_id") % 3 != 0, C.record("LNG", raw("lang"))), C.record("TXT", raw("text"))))
    made = docs.select("doc_id", raw("text").alias("text"), C.joined(records).alias("raw"))
    read = made.select("doc_id", "text", "raw", C.records(F.col("raw")).alias("r"))
    told = F.array_join(F.transform("r", lambda r: F.concat(r["tag"], F.lit(":"), F.length(r["body"]))), ",")
    body = F.get(F.filter("r", lambda r: r["tag"] == "TXT"), 0)["body"]
    return read.select("doc_id", F.md5(F.hex("raw")).alias("md5"), F.size("r").alias("records"), told.alias("told"), (body == F.col("text")).alias("equal"))


@query("""SELECT p_partkey AS image_id, CAST(c AS INT) AS component, CAST(1 + c AS BIGINT) AS jid, CAST(CASE WHEN c = 0 THEN 1 + p_size % 2 ELSE 1 END AS BIGINT) AS sh, CAST(CASE WHEN c = 0 THEN 1 + p_partkey % 2 ELSE 1 END AS BIGINT) AS sv,
  CAST(CASE WHEN c = 0 THEN 0 ELSE p_partkey % 3 END AS BIGINT) AS quant, CASE WHEN c = 0 OR p_partkey % 3 < 2 THEN CAST(7 + CASE WHEN c = 0 THEN 0 ELSE p_partkey % 3 END AS BIGINT) END AS first_quant FROM part, (SELECT unnest(range(3)) AS c) WHERE TRUE""")
def frame_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of each header's frame: id, sampling factors and quantiser table, whose first value is null where the header lacks the table."""
    k = F.col("p_partkey")
    factors = G.byte((1 + F.col("p_size") % 2) * 16 + 1 + k % 2)
    own = F.concat(G.byte(8), bits.big_endian(F.col("p_size") * 53), bits.big_endian(k * 37 % 4000 + 1), F.unhex(F.lit("0301")), factors, F.unhex(F.lit("000211")), G.byte(k % 3), F.unhex(F.lit("0311")), G.byte(k % 3))
    tables = F.concat(*(F.unhex(F.lit(f"0{t}0{7 + t}" + "01" * 63)) for t in range(2)))
    raw = F.concat(F.unhex(F.lit("FFD8")), G.segment(G.QUANT_TABLE, tables), G.segment(G.FRAME, own), G.segment(G.SCAN, F.unhex(F.lit("010100003F00"))))
    found = table(spark, sf_dir, "part").select(k.alias("image_id"), G.segments(raw).alias("s"))
    return found.select("image_id", F.posexplode(G.components(F.col("s"))).alias("component", "c")).select("image_id", "component", "c.*")
