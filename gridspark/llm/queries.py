"""Registered queries opN_<name> of the operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, lm, media, quality, sharding, simhash, substring, suffix
from .common import table_of

SHARDS = [f"shard-{k:03d}" for k in range(128)]


def tokenizer_path() -> str:
    """The vocabulary file; LLM_TOKENIZER names another one."""
    if path := os.environ.get("LLM_TOKENIZER"):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table_of(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, tokenizer_path(), ids=False, cache=2 * bpe.CACHE).drop("text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table_of(spark, sf_dir, "benchmark")).drop("text", "cleaned")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table_of(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.trained(docs, table_of(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector played as a tune; every hundredth is a query against all."""
    tunes = media.played(table_of(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = media.aligned(tunes, "id", "audio", F.col("id") % 100 == 0)
    nearest = (F.col(f"nearest.{c}").alias(f"nearest_{c}") for c in ("class_id", "offset", "bit_errors", "overlap"))
    return found.select(F.col("id").alias("vec_id"), "class_id", "n_ints", "is_query", "n_links", *nearest)


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.backoff_scores(table_of(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: A conversation whose texts hold control strings of other formats.
PROBE = "SELECT bigint(-7) AS conv_id, bigint(turn) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table_of(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.sql(PROBE))
    back = chat.read_back(chat.formatted(turns))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "end_state",
        "valid",
    )


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.repeated_windows(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, dw.size, i, item_id FROM dw JOIN bw USING (size, gram)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, n, b, substr(h, 2 * b + 1, 2 * 1223) AS h FROM (SELECT *, unnest(range(0, greatest(n - 199, 0), 1024)) AS b FROM d)),
g AS (SELECT doc_id, b + j AS i, md5_number(substr(h, 2 * j + 1, 400)) AS k FROM (SELECT *, unnest(range(least(1024, n - 199 - b))) AS j FROM c)),
r AS (SELECT doc_id, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
m AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS e FROM m GROUP BY doc_id, span),
k AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
t AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(e) AS last, sum(e - a) AS gone, count(*) AS n_spans FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS own, w[i] AS w0, w[i - 1] AS w1, CASE WHEN i > 2 THEN w[i - 2] END AS w2, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, w0) AS o1, count(*) OVER (PARTITION BY doc_id, w1, w0) AS o2, count(*) OVER (PARTITION BY doc_id, w2, w1, w0) AS o3
  FROM (SELECT doc_id, own, i, w0, CASE WHEN i > 1 THEN w1 END AS w1, w2 FROM t)),
c1 AS (SELECT w0 AS a, count(*) AS n FROM u GROUP BY 1),
c2 AS (SELECT w1 AS a, w0 AS b, count(*) AS n FROM u WHERE w1 IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT w2 AS a, w1 AS b, w0 AS c, count(*) AS n FROM u WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT count(*) AS total, CAST(round(1e6 * ln(0.4)) AS BIGINT) AS off FROM u),
n AS (
  SELECT u.doc_id, u.own, i, w1, w2, c1.n - o1 AS n1, c2.n - o2 AS n2, c3.n - o3 AS n3, p1.n - lag(o1) OVER x AS h1, p2.n - lag(o2) OVER x AS h2
  FROM u JOIN c1 ON c1.a = u.w0 LEFT JOIN c2 ON c2.a = u.w1 AND c2.b = u.w0 LEFT JOIN c3 ON c3.a = u.w2 AND c3.b = u.w1 AND c3.c = u.w0
    LEFT JOIN c1 p1 ON p1.a = u.w1 LEFT JOIN c2 p2 ON p2.a = u.w2 AND p2.b = u.w1
  WINDOW x AS (PARTITION BY u.doc_id ORDER BY i)),
s AS (
  SELECT doc_id, CASE WHEN n3 >= 1 THEN 3 WHEN n2 >= 1 THEN 2 ELSE 1 END AS level,
    CASE WHEN n3 >= 1 THEN CAST(round(1e6 * ln(n3)) AS BIGINT) - CAST(round(1e6 * ln(h2)) AS BIGINT)
      WHEN n2 >= 1 THEN CAST(round(1e6 * ln(n2)) AS BIGINT) - CAST(round(1e6 * ln(h1)) AS BIGINT) + CASE WHEN w2 IS NULL THEN 0 ELSE off END
      ELSE CAST(round(1e6 * ln(greatest(n1, 1))) AS BIGINT) - CAST(round(1e6 * ln(greatest(total - own, 1))) AS BIGINT) + CASE WHEN w1 IS NULL THEN 0 WHEN w2 IS NULL THEN off ELSE 2 * off END END AS s
  FROM n CROSS JOIN k)
SELECT d.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (level = 1) AS n_1, count(*) FILTER (level = 2) AS n_2, count(*) FILTER (level = 3) AS n_3, CAST(coalesce(sum(s), 0) AS BIGINT) AS score_micro
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""

OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\0'), '<', '\1'), '[INST]', '[\2INST]'), '[/INST]', '[\2/INST]'), '[SYS]', '[\2SYS]'), '[/SYS]', '[\2/SYS]') AS etext,
    replace(replace(replace(replace(replace(replace(role, '\', '\0'), '<', '\1'), '[INST]', '[\2INST]'), '[/INST]', '[\2/INST]'), '[SYS]', '[\2SYS]'), '[/SYS]', '[\2/SYS]') AS erole FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>' || erole || '<|text|>' || etext || '<|end|>')) AS BIGINT) AS formatted_chars,
  list_reduce(list_prepend('start', list(role ORDER BY turn NULLS FIRST, role, text)), lambda s, r: CASE
    WHEN s = 'start' AND r = 'system' THEN 'told' WHEN s IN ('start', 'told', 'answered') AND r = 'user' THEN 'asked'
    WHEN s = 'asked' AND r = 'assistant' THEN 'answered' ELSE 'invalid' END) AS end_state, end_state = 'answered' AS valid
FROM e GROUP BY conv_id
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) u
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(p) AS p FROM gone) o WHERE o.doc_id = u.doc_id AND o.p = u.i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_media": op6_media,
    "op7_suffix": op7_suffix,
    "op8_lm": op8_lm,
    "op9_chat": op9_chat,
    "op10_substring": op10_substring,
}

ORACLE_SQL = {"op3_decontaminate": OP3_SQL, "op7_suffix": OP7_SQL, "op8_lm": OP8_SQL, "op9_chat": OP9_SQL, "op10_substring": OP10_SQL}
