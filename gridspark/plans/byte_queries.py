"""Queries on bytes, literals and containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import bytestreams as Z
from ..sources.views import blocks, events, table
from ..streaming import jobs
from .registry import BLK, query

DOC_BYTES = "x AS (SELECT doc_id, lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h, unnest(range(octet_length(encode(text)))) AS i, octet_length(encode(text)) AS n FROM documents)"


@query("""SELECT doc_id, md5(text) AS md5, octet_length(encode(text)) AS n_bytes, TRUE AS equal, md5(substr(text, 11, 20)) AS slice_md5 FROM documents""")
def md5_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode whole texts; length and digest must agree."""
    back = F.decode(F.unbase64(F.base64(F.unhex(F.hex(F.encode("text", "UTF-8"))))), "UTF-8")
    same = (F.md5(back) == F.md5("text")) & (F.octet_length(back) == F.octet_length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("n_bytes"), same.alias("equal"), F.md5(F.substring("text", 11, 20)).alias("slice_md5"))


@query(f"""WITH {DOC_BYTES}
SELECT doc_id, CAST((1 + sum(CAST('0x' || h AS INT))) % 65521 + 65536 * ((any_value(n) + sum((n - i) * CAST('0x' || h AS INT))) % 65521) AS BIGINT) AS adler FROM x GROUP BY doc_id""")
def adler32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adler-32 of whole texts, in closed form over chunks."""
    return Z.adler32(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH {DOC_BYTES}, c AS (SELECT lang, h, count(*) AS n FROM x GROUP BY lang, h)
SELECT lang, CAST(sum(n) AS BIGINT) AS n_bytes, count(*) AS kinds, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY lang""")
def byte_histogram_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the byte histogram of each language."""
    c = Z.byte_counts(table(spark, sf_dir, "documents"), "lang", "text")
    total = F.sum("n")
    return c.groupBy("lang").agg(total.alias("n_bytes"), F.count("*").alias("kinds"), F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 6).alias("entropy"))


@query("""WITH s AS (SELECT doc_id, text, replace(text, 'e', 'e0') AS t FROM documents)
SELECT doc_id, octet_length(encode(t)) AS n_bytes, md5(t) AS md5, TRUE AS equal FROM s""")
def byte_stuffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filler after each byte of a kind, and its removal."""
    raw = F.encode("text", "UTF-8")
    s = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), bits.stuffed(raw, ord("e"), ord("0")).alias("s"))
    return s.select("doc_id", F.length("s").cast("long").alias("n_bytes"), F.md5("s").alias("md5"), (bits.unstuffed(F.col("s"), ord("e"), ord("0")) == F.col("raw")).alias("equal"))


@query("""WITH x AS (SELECT o_orderkey, lpad(hex(o_orderkey), 8, '0') AS h FROM orders)
SELECT o_orderkey, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS little, substr(h, 5, 4) AS big, o_orderkey AS from_little, o_orderkey % 65536 AS from_big FROM x""")
def le_be_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as little-endian and big-endian bytes, and back."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, bits.little_endian(k).alias("l"), bits.big_endian(k).alias("b"))
    return rows.select("o_orderkey", F.hex("l").alias("little"), F.hex("b").alias("big"), bits.from_little_endian(F.col("l")).alias("from_little"), bits.from_big_endian(F.col("b")).alias("from_big"))


@query("""WITH s AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || (['', 'K', 'M', 'G', 'k'])[p_partkey % 5 + 1] AS size, CAST(p_size AS VARCHAR) || (['s', 'ms', 'us', 'm'])[p_partkey % 4 + 1] AS time FROM part)
SELECT p_partkey, size, CASE WHEN regexp_matches(size, '^\\d{1,16}$') THEN CAST(size AS BIGINT) WHEN regexp_matches(size, '^\\d{1,16}K$') THEN CAST(size[:-2] AS BIGINT) * 1024 WHEN regexp_matches(size, '^\\d{1,16}M$') THEN CAST(size[:-2] AS BIGINT) * 1048576 END AS n_bytes,
  CASE WHEN regexp_matches(time, '^\\d+s$') THEN CAST(time[:-2] AS BIGINT) * 1000 WHEN regexp_matches(time, '^\\d+ms$') THEN CAST(time[:-3] AS BIGINT) WHEN regexp_matches(time, '^\\d+us$') THEN CAST(time[:-3] AS BIGINT) // 1000 END AS ms,
  starts_with(size, '1') AS starts FROM s""".replace("\\\\", "\\"))
def size_literal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and time literals."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    s = table(spark, sf_dir, "part").select("p_partkey", F.concat(n, F.get(F.array(*map(F.lit, ("", "K", "M", "G", "k"))), (k % 5).cast("int"))).alias("size"), F.concat(n, F.get(F.array(*map(F.lit, ("s", "ms", "us", "m"))), (k % 4).cast("int"))).alias("time"))
    return s.select("p_partkey", "size", bits.size_literal(F.col("size")).alias("n_bytes"), bits.time_literal_ms(F.col("time")).alias("ms"), F.startswith("size", F.lit("1")).alias("starts"))


@query("""SELECT url, CASE WHEN regexp_matches(url, '\\.[^./]*$') THEN regexp_replace(url, '\\.[^./]*$', '.arc') ELSE url || '.arc' END || repeat('_', CAST(row_number() OVER (PARTITION BY CASE WHEN regexp_matches(url, '\\.[^./]*$') THEN regexp_replace(url, '\\.[^./]*$', '.arc') ELSE url || '.arc' END ORDER BY page_id) - 1 AS INT)) AS name,
  CASE WHEN starts_with(html, '<!') THEN 'doctype' WHEN starts_with(html, '<h') THEN 'html' ELSE 'other' END AS kind FROM pages""".replace("\\\\", "\\"))
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each page's output, made unique, and what its first bytes say."""
    pages = table(spark, sf_dir, "pages")
    return Z.named(pages, "url", "page_id", ".arc").withColumn("kind", Z.sniffed(F.col("html"))).select("url", "name", "kind")


@query("""SELECT doc_id, CASE WHEN n = 0 THEN 1 ELSE (n + 65534) // 65535 END AS chunks, n + 5 * CASE WHEN n = 0 THEN 1 ELSE (n + 65534) // 65535 END + 6 AS size FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)""")
def stored_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored-block streams: chunks of 65,535 bytes and the stream's size."""
    n = F.octet_length("text").cast("long")
    chunks = F.when(n == 0, 1).otherwise(bits.ceil_div(n, 65535)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", chunks.alias("chunks"), (n + 5 * chunks + 6).alias("size"))


@query(f"""WITH {BLK},
h AS (SELECT vec_id, vec_id // 1600 AS batch, array_to_string(list_transform(coef, lambda v: lpad(hex((v + 65536) % 65536), 4, '0')), '') AS h FROM blk)
SELECT vec_id, batch, md5(h) AS md5, TRUE AS equal FROM h""")
def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as raw 16-bit coefficients, in batches of 1,600, and read back."""
    return Z.raw_blocks(blocks(spark, sf_dir))


@query("""WITH b AS (SELECT user_id, event_type = 'click' AS bit, lag(event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) AS n_bits, count(*) FILTER (bit) AS ones, count(*) FILTER (before IS NULL OR before <> bit) AS runs, TRUE AS equal FROM b GROUP BY user_id""")
def bool_coder_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's bits as runs of equal ones, and opened again."""
    return Z.run_coded(events(spark, sf_dir), "user_id", ["ts", "event_id"], "bit")


@query("""SELECT doc_id, 'CF8401' || hex('Z') || lpad(hex(doc_id % 8 + 1), 2, '0') || '000000' || substr(upper(md5(source)), 1, 24) AS head, octet_length(encode(text)) AS n_bytes, CAST(doc_id % 8 + 1 AS BIGINT) AS segments, 'baseline' AS mode FROM documents""")
def archive_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed prefix of a block archive for each document, and its fields read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") % 8 + 1).alias("segments"), F.substring(F.md5("source"), 1, 24).alias("revision"))
    made = docs.select("doc_id", Z.archive_prefix(F.lit(1), F.lit("Z"), F.col("segments"), F.col("revision"), F.col("size"), F.lit(0)).alias("raw"))
    return made.select("doc_id", F.hex(F.substring("raw", 1, 20)).alias("head"), *Z.read_prefix(F.col("raw")))


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, md5(text) AS md5, TRUE AS equal FROM documents")
def stored_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written compressed to the shared folder, and validated by reading them back."""
    return Z.stored(table(spark, sf_dir, "documents"), "doc_id", "text", jobs.shared_folder(spark)).withColumnRenamed("id", "doc_id")


@query("SELECT doc_id, md5(text) AS md5, octet_length(encode(text)) AS n_bytes FROM documents")
def stream_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service over arriving documents: one answer for each request, a bounded number of files at a time."""
    return jobs.answered_stream(spark, sf_dir)
