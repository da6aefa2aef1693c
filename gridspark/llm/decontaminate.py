"""Benchmark decontamination: document windows looked up in a broadcast hash set of benchmark windows."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, checkpointed, gathered, numbered, without_columns, word_hashes

#: Bytes of benchmark text whose windows are broadcast themselves; a larger benchmark is broadcast as a bitmap of window hashes.
BLOCK_BYTES = 2 << 20
#: Bits of that bitmap, 16 MB.
BITMAP = 1 << 27
BASE = 0x9E3779B97F4A7C15

#: A-Z to a-z; every other ASCII byte that is no letter or digit to a space; bytes of non-ASCII characters stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Windows:
    """The windows of a block of benchmark items, by length; words are numbered within the block."""

    def __init__(self, items: list[tuple[str, str | None]], width: int) -> None:
        self.number: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(width, len(ids))
            for at in range(len(ids) - size + 1) if ids else ():
                found[size][tuple(ids[at : at + size])].add(item)
        self.by_size = {}
        for size, windows in found.items():
            rolling, by_hash = Rolling(BASE), defaultdict(list)
            for window in windows:
                by_hash[int(rolling.windows(np.array(window, np.uint64), size)[0])].append(window)
            self.by_size[size] = (np.array(sorted(by_hash), np.uint64), dict(by_hash), {k: frozenset(v) for k, v in windows.items()})

    def scan(self, words: list[bytes], rolling: Rolling) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items of those windows."""
        hit, items = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.uint64, len(words))
        for size, (hashes, by_hash, windows) in self.by_size.items():
            h = rolling.windows(ids, size)
            if not len(h):
                continue
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            for start in np.flatnonzero(hashes[at] == h).tolist():
                window = tuple(ids[start : start + size].tolist())
                if window in by_hash[int(h[start])]:  # the words themselves, not only their hash
                    hit[start : start + size] = True
                    items |= windows[window]
        return hit, items


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, ratio: int = 20, spans: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of df and n_words, n_hit, n_items, items_sha256, contaminated, cleaned.

    Words are lower-cased runs of ASCII letters and digits and of non-ASCII
    characters. An item's windows are its ``width`` consecutive words, or all of
    them if it has fewer; a document word within an occurrence of any window is
    hit, and a document is contaminated from one hit word in ``ratio`` words.
    Null and empty texts have no words and are clean; items without words have
    no windows; items with equal ids or texts count once per id; a null item id
    is the empty string. ``cleaned`` is the text without its hit words (null
    unless spans=True and the document has hits). Columns of df with these
    result names, in capitals or not, are replaced. Repeated rows are judged
    each on their own; an empty df gives no rows, an empty benchmark no hits.

    A benchmark of at most ``block_bytes`` of text is broadcast as a hash set of
    its windows. Of a larger one only a bitmap of window hashes, of fixed size, is
    broadcast; windows that it lets through are joined to the benchmark's by
    their words, so false ones fall away, and texts are read twice but only cross
    the network to meet their hits. Either way there is one pass for any
    benchmark, and the driver and tasks hold no more than these bounds.
    """
    made = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean", "cleaned": "string"}
    base = without_columns(df, made)
    at_text = base.columns.index(text_col)
    rows = numbered(base)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("octet_length(text) > 0")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    schema = ", ".join([own, *(f"{k} {v}" for k, v in made.items())])

    def judged(text: str | None, words: list[bytes], hit: np.ndarray, found: set[str]) -> tuple:
        n = int(hit.sum())
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        return len(words), n, len(found), digest, n > 0 and ratio * n >= len(words), without(text, hit) if spans and n else None

    def told(table: pa.Table, judgements: list[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
        new = [pa.array(x, kind) for x, kind in zip(zip(*judgements, strict=True), kinds, strict=True)]
        yield from pa.table([*table.columns[: len(rows_columns)], *new], names=[*rows_columns, *made]).to_batches()

    rows_columns = rows.columns
    if size <= block_bytes:
        held = df.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in items.collect()], width))

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rolling = Rolling(BASE)
            for table in gathered(batches):
                out = []
                for text in table.column(at_text).to_pylist():
                    words = words_of(text)
                    out.append(judged(text, words, *held.value.scan(words, rolling)))
                yield from told(table, out)

        return rows.mapInArrow(scanned, schema).toDF(*base.columns, *made)

    text = F.col(f"c{at_text}")
    hits = _hits(rows.select(text.cast("string").alias("text")), items, width)
    met = rows.withColumn("key", F.md5(text.cast("binary"))).join(hits, "key", "left").drop("key").select(*rows_columns, "starts", "sizes", "items")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            out = []
            for text, *found in zip(*(table.column(c).to_pylist() for c in (at_text, "starts", "sizes", "items")), strict=True):
                words = words_of(text)
                starts, sizes, items_of = (x or [] for x in found)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.array(starts, np.int64), 1)
                np.add.at(edge, np.array(starts, np.int64) + np.array(sizes, np.int64), -1)
                out.append(judged(text, words, np.cumsum(edge[:-1]) > 0, set(items_of)))
            yield from told(table, out)

    return met.mapInArrow(joined, schema).toDF(*base.columns, *made)


def _hits(texts: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(key, starts, sizes, items) of each distinct text, by its MD5, that holds windows of items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASE)
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(width, len(words))
                if size:
                    h = rolling.windows(word_hashes(words), size).view(np.int64)
                    grams = [b" ".join(words[i : i + size]).decode() for i in range(len(h))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(h), pa.string()), pa.array([size] * len(h), pa.int32()), pa.array(h), pa.array(grams, pa.string())], ["item", "size", "hash", "gram"])

    windows = checkpointed(items.mapInArrow(cut, "item string, size int, hash long, gram string").distinct())
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # width at most
    bit = F.pmod(F.col("hash"), F.lit(BITMAP)) + 1
    parts = windows.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bitmap, wide = np.zeros(BITMAP // 8, np.uint8), 32768 // 8
    for b, bits in parts:
        bitmap[(b - 1) * wide : b * wide] = np.frombuffer(bits, np.uint8)
    held = texts.sparkSession.sparkContext.broadcast(bitmap)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASE)
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                h = word_hashes(words)
                for size in sizes:
                    at = (rolling.windows(h, size).view(np.int64) % BITMAP) if len(words) >= size else np.zeros(0, np.int64)
                    for i in np.flatnonzero(held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                        for x, y in zip(out, (key, size, i, b" ".join(words[i : i + size]).decode()), strict=True):
                            x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["key", "size", "start", "gram"])

    maybe = texts.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("key"), "text").mapInArrow(seen, "key string, size int, start int, gram string").distinct()
    found = maybe.join(windows.select("size", "gram", "item"), ["size", "gram"])
    places = found.select("key", "start", "size").distinct().groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("p"))
    named = found.groupBy("key").agg(F.collect_set("item").alias("items"))
    return places.join(named, "key").select("key", F.col("p.start").alias("starts"), F.col("p.size").alias("sizes"), "items")


def without(text: str, hit: np.ndarray) -> str:
    """text without its hit words; what stood between the words stays."""
    raw = text.encode()
    letters = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edge = np.diff(letters.astype(np.int8), prepend=0)
    word = np.cumsum(edge == 1) - 1
    drop = letters & hit[np.maximum(word, 0)]
    return np.frombuffer(raw, np.uint8)[~drop].tobytes().decode()


def decontaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of df that are not contaminated, with df's own columns and their values, whatever their names."""
    found = contamination(numbered(df), benchmark, text_col=f"c{df.columns.index(text_col)}", **options)
    return found.where("not contaminated").select(*numbered(df).columns).toDF(*df.columns)
